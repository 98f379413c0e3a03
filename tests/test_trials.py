"""The trial of forecasting ways against the same thing said in plain loops over one series."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest

from tidemark.errors import Refused
from tidemark.operators import trials

START = dt.datetime(2031, 3, 1)
EVEN = 5000


def walk(seed, n, gaps=False, zero=False):
    r, v, t, out = random.Random(seed), 50.0, START, []
    for i in range(n):
        out.append((t, v))
        v = round(v * math.exp(r.gauss(0.0005, 0.03)), 3)
        if zero and i % 97 == 50:
            out[-1] = (t, 0.0)
        t += dt.timedelta(days=r.choice([1, 1, 2, 4]) if gaps else 1, hours=r.choice([0, 5]) if gaps else 0)
    return out


def holds(asked, x):
    return {"above": x > asked.change_pct, "below": x < asked.change_pct, "at_least": x >= asked.change_pct, "at_most": x <= asked.change_pct}[asked.comparison]


def cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def stated(series, asked, at):
    days = lambda d: dt.timedelta(days=d)
    known = [p for p in series if p[0] <= at]
    if not known or known[-1][1] == 0:
        return None
    ways = asked.ways()
    past = []
    for i, (t, v) in enumerate(known):
        inside = [(w / v - 1) * 100 for s, w in known[i + 1 :] if s <= t + days(asked.days)] if v else []
        if t + days(asked.days) <= known[-1][0] and inside:
            past.append((i, any(holds(asked, x) for x in inside) if asked.window == "any_time" else holds(asked, inside[-1])))

    def stood(i, kind, d):
        then = [v for t, v in known[:i] if t <= known[i][0] - days(d)]
        if not then:
            return None
        recent = [v for t, v in known[: i + 1] if t > known[i][0] - days(d)]
        x = known[i][1] - (then[-1] if kind == "going" else sum(reversed(recent)) / len(recent))
        return (x > 0) - (x < 0)

    said = []
    for kind, d in ways:
        rate = None
        if kind == "often":
            counted = [h for i, h in past if d is None or known[i][0] >= at - days(d)]
            rate = sum(counted) * 10000 // len(counted) if counted else None
        elif kind == "swings":
            recent = [v for t, v in known if t > at - days(d)]
            moves = [math.log(b / a) for a, b in zip(recent, recent[1:], strict=False) if a > 0 and b > 0]
            if len(moves) >= 2:
                spread, ahead = statistics.stdev(moves), len(moves) * asked.days / d
                up = asked.comparison in ("above", "at_least")
                p = (1.0 if holds(asked, 0.0) else 0.0) if spread == 0 else cdf((-1 if up else 1) * math.log(1 + asked.change_pct / 100) / (spread * math.sqrt(ahead)))
                rate = math.floor((min(2 * p, 1.0) if asked.window == "any_time" else p) * 10000 + 0.5)
        else:
            now = stood(len(known) - 1, kind, d)
            alike = [h for i, h in past if now is not None and stood(i, kind, d) == now]
            rate = sum(alike) * 10000 // len(alike) if alike else None
        said.append(None if rate is None else max(100, min(9900, rate)))
    return None if all(x is None for x in said) else [EVEN if x is None else x for x in said]


def by_hand(series, asked):
    days = dt.timedelta(days=1)
    at, rows, left = series[0][0] + asked.every_days * days, [], 0
    while at + asked.days * days <= series[-1][0]:
        said, start = stated(series, asked, at), [v for t, v in series if t <= at][-1]
        after = [(v / start - 1) * 100 for t, v in series if at < t <= at + asked.days * days] if start else []
        if said is None or not after:
            left += 1
        else:
            rows.append((at, said, any(holds(asked, x) for x in after) if asked.window == "any_time" else holds(asked, after[-1])))
        at += asked.every_days * days
    brier = lambda p, came: (10000 - p if came else p) ** 2 // 10000
    full = []
    for at, said, came in rows:
        more = []
        for w, p in enumerate(said):
            old = [c for a, s, c in rows if a + asked.days * days <= at and min(s[w] // 1000, 9) == min(p // 1000, 9)]
            more.append(max(100, min(9900, (sum(old) * 10000 + 5 * p) // (len(old) + 5))))
        full.append((at, said + more, came))
    n, k = len(full), asked.stretches
    cut = [i * n // (k + 1) for i in range(k + 2)]
    mean = lambda rs, w: sum(brier(s[w], c) for _, s, c in rs) // len(rs)
    out = []
    for j in range(1, k + 1):
        test = full[cut[j] : cut[j + 1]]
        old = [m for m in full[: cut[j]] if m[0] + asked.days * days <= test[0][0]]
        totals = [sum(brier(s[w], c) for _, s, c in old) for w in range(2 * len(asked.ways()))]
        best = totals.index(min(totals))
        out.append((j, test[0][0], test[-1][0], len(old), [t // len(old) for t in totals], best, len(test), sum(c for *_, c in test), mean(test, best), [mean(test, w) for w in range(len(totals))]))
    return full, left, out


CASES = [trials.Asked("at_most", -1.5, 10, 11, "any_time", 3), trials.Asked("above", 1.0, 40, 13, stretches=2)]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_trial_by_hand(spark, case):
    asked = CASES[case]
    many = {"plain": walk(case, 420), "gaps": walk(case + 50, 330, gaps=True, zero=True)}
    s = spark.createDataFrame([(k, t, v) for k, x in many.items() for t, v in x], "series_id string, time timestamp, value double").cache()
    told = {}
    for r in trials.moments(s, asked).collect():
        told.setdefault((r.series_id, r.time), {})[r.way] = (r.said_bps, r.came_true)
    report, stretches = trials.trial(s, asked)
    report, stretches = {r.series_id: r for r in report.collect()}, stretches.orderBy("series_id", "stretch").collect()
    for k, x in many.items():
        full, left, want = by_hand(x, asked)
        assert {t: [p for p, _ in (v[w] for w in sorted(v))] for (i, t), v in told.items() if i == k} == {t: said for t, said, _ in full}
        assert {t: v[0][1] for (i, t), v in told.items() if i == k} == {t: c for t, _, c in full}
        got = [tuple(r[c] for c in ("stretch", "from", "to", "learned_from", "learned_bps", "chosen", "tested", "came_true", "chosen_bps", "each_bps")) for r in stretches if r.series_id == k]
        assert got == want
        r = report[k]
        assert (r.moments, r.left_out, r.tested, r["from"], r.to) == (len(full), left, sum(w[6] for w in want), full[0][0], full[-1][0])
        assert sum(c.forecasts for c in r.calibration) == r.tested and sum(c.came_true for c in r.calibration) == r.came_true


def test_refusals(spark):
    s = spark.createDataFrame([("a", t, v) for t, v in walk(1, 60)], "series_id string, time timestamp, value double")
    with pytest.raises(Exception, match="TOO_SHORT"):
        trials.trial(s, trials.Asked("above", 1.0, 7, 7))[0].collect()
    for bad, code in ((lambda: trials.Asked("above", 1.0, 0, 7), "NOT_A_COUNT"), (lambda: trials.Asked("over", 1.0, 1, 7), "NOT_A_CHOICE"), (lambda: trials.Asked("above", math.nan, 1, 7), "NOT_A_NUMBER")):
        with pytest.raises(Refused, match=code):
            bad()
    assert trials.moments(s.limit(0), trials.Asked("above", 1.0, 7, 7)).count() == 0
    assert not any(kind == "often" and d and d <= 90 for kind, d in trials.Asked("above", 1.0, 90, 7).ways())
