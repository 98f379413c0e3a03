"""Ways of forecasting, tried on the history of series: what each would have said at moments of the past, how that came out,
and which way would have been chosen stretch by stretch.

A statement is a change of so many percent, so many days ahead. Everything that a moment may look at is a window or a
lookup within its series: running counts along the points, read off at the times that bound what was known then; swings are
grouped by the moments that see them. Shares and scores are whole basis points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused, choice, refuse_when, whole
from ..functions import decisions as D
from ..functions.options import norm_cdf
from ..scratch import held as kept
from .series import KEY, TIME, VALUE, sound

DAY = 86_400_000_000
COUNTS_AS = 5
PER_STRETCH = 5
SIGNS = (-1, 0, 1)

#: What is tried, in order (None: all history known).
WAYS = (
    ("often", 30), ("often", 90), ("often", 180), ("often", 365), ("often", None),
    ("going", 5), ("going", 20), ("going", 60), ("side", 20), ("side", 60), ("swings", 30), ("swings", 90),
)


@dataclass(frozen=True)
class Asked:
    """above, below, at_least or at_most ``change_pct`` percent from where a series stands, ``days`` ahead: at the deadline, or
    at any_time before it; tried every ``every_days`` days and tested on ``stretches`` stretches of moments."""

    comparison: str
    change_pct: float
    days: int
    every_days: int
    window: str = "at_deadline"
    stretches: int = 5

    def __post_init__(self):
        choice(self.comparison, ("above", "below", "at_least", "at_most"), "comparison")
        choice(self.window, ("at_deadline", "any_time"), "window")
        for n in ("days", "every_days", "stretches"):
            whole(getattr(self, n), n)
        if not math.isfinite(self.change_pct):
            raise Refused("NOT_A_NUMBER", "the change asked for is a number", "change_pct")

    @property
    def up(self) -> bool:
        return self.comparison in ("above", "at_least")

    def holds(self, change: Column) -> Column:
        t = self.change_pct
        return {"above": change > t, "below": change < t, "at_least": change >= t, "at_most": change <= t}[self.comparison]

    def held(self, start: Column, last: Column, high: Column, low: Column) -> Column:
        """Whether it held over values after ``start``, of which the last, highest and lowest are given."""
        end = F.when((start > 0) == F.lit(self.up), high).otherwise(low) if self.window == "any_time" else last
        return self.holds((end / F.nullif(start, F.lit(0.0)) - 1) * 100)

    def ways(self) -> list[tuple[str, int | None]]:
        """The ways that speak for the horizon: counts look back further than it looks ahead."""
        return [(kind, days) for kind, days in WAYS if kind != "often" or days is None or days > self.days]


def name_of(kind: str, days: int | None, read: bool = False) -> str:
    said = {
        "often": f"how often it held in the last {days} days" if days else "how often it held in all history known", "going": f"how often it held after going the same way over {days} days",
        "side": f"how often it held on the same side of the {days}-day average", "swings": f"how likely a move that size is, from the swings of the last {days} days",
    }[kind]
    return said + ", read through its record" * read


def _look_ahead(t: str, micros: int) -> dict[str, Column]:
    """last, highest, lowest and number of values (``v``) after a row and up to so many microseconds later."""
    w = Window.partitionBy(KEY).orderBy(t).rangeBetween(1, micros)
    return {"last": F.last("v", ignorenulls=True).over(w), "high": F.max("v").over(w), "low": F.min("v").over(w), "after": F.count("v").over(w)}


def _standings(ways: list[tuple[str, int | None]]) -> list[tuple[str, int]]:
    return [w for w in ways if w[0] in ("going", "side")]


def _points(s: DataFrame, asked: Asked) -> DataFrame:
    """Points (t, v) with whether the statement held over the stretch from each, how things stood there, and running counts
    of the stretches so far: all, and by sign of how things stood."""
    p = sound(s).select(KEY, F.unix_micros(TIME).alias("t"), F.col(VALUE).alias("v")).withColumn("back", -F.col("t"))
    p = p.withColumns(_look_ahead("t", asked.days * DAY))
    stretch = (F.col("v") != 0) & (F.col("after") > 0)
    by_time, latest_first = Window.partitionBy(KEY).orderBy("t"), Window.partitionBy(KEY).orderBy("back")
    stood = {}
    for kind, days in _standings(asked.ways()):
        then = F.last("v").over(by_time.rangeBetween(Window.unboundedPreceding, -days * DAY))
        w = latest_first.rangeBetween(0, days * DAY - 1)
        base = then if kind == "going" else F.when(then.isNotNull(), F.sum("v").over(w) / F.count("v").over(w))
        stood[f"{kind}{days}"] = F.signum(F.col("v") - base).cast("int")
    p = p.withColumns({"stretch": stretch, "held": F.coalesce(stretch & asked.held(F.col("v"), F.col("last"), F.col("high"), F.col("low")), F.lit(False)), **stood})
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda test: F.sum(test.cast("bigint")).over(so_far)
    counts = {"c": count(F.col("stretch")), "h": count(F.col("held"))}
    for k in stood:
        for sign in SIGNS:
            alike = F.coalesce(F.col(k) == sign, F.lit(False))
            counts |= {f"{k}_c{sign}": count(F.col("stretch") & alike), f"{k}_h{sign}": count(F.col("held") & alike)}
    return p.select(KEY, "t", "v", *stood, *(x.alias(n) for n, x in counts.items()))


def _looked_up(points: DataFrame, asked_at: DataFrame) -> DataFrame:
    """``asked_at`` (series_id, at, tag, t) with ``p``: the last point at or before t."""
    what = F.struct(*(c for c in points.columns if c != KEY))
    both = points.select(KEY, "t", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("tag"), what.alias("p"))
    both = both.unionByName(asked_at.select(KEY, "t", F.lit(1).alias("side"), "at", "tag"), allowMissingColumns=True)
    w = Window.partitionBy(KEY).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("side = 1").drop("side")


def _swings(points: DataFrame, grid: DataFrame, days: int, asked: Asked) -> DataFrame:
    """(series_id, at, rate) from the spread of the moves that lie within so many days before a moment, end to end."""
    w = Window.partitionBy(KEY).orderBy("t")
    moves = points.select(KEY, "t", F.lag("t").over(w).alias("p"), F.when((F.col("v") > 0) & (F.lag("v").over(w) > 0), F.log(F.col("v") / F.nullif(F.lag("v").over(w), F.lit(0.0)))).alias("m")).where("m IS NOT NULL")
    every = asked.every_days * DAY
    span = grid.groupBy(KEY).agg(F.min("at").alias("a"), F.max("at").alias("z"))
    up = lambda x: D.floor_div(x - F.col("a") + (every - 1), every)
    k0, k1 = F.greatest(up(F.col("t")), F.lit(0)), F.least(up(F.col("p") + days * DAY) - 1, up(F.col("z")))
    seen = moves.join(span, KEY).withColumns({"k0": k0, "k1": k1}).where("k0 <= k1").select(KEY, "m", F.explode(F.sequence("k0", "k1")).alias("k"), "a")
    held = seen.groupBy(KEY, (F.col("a") + F.col("k") * every).alias("at")).agg(F.count("*").alias("n"), F.stddev_samp("m").alias("s")).where("n >= 2")
    ahead = F.col("n") * float(asked.days) / float(days)
    if asked.change_pct <= -100:
        end = F.lit(1.0 if asked.up else 0.0)
    else:
        above = 1 - norm_cdf(F.lit(math.log(1 + asked.change_pct / 100)) / F.nullif(F.col("s") * F.sqrt(ahead), F.lit(0.0)))
        end = F.when(F.col("s") == 0, asked.holds(F.lit(0.0)).cast("double")).otherwise(above if asked.up else 1 - above)
    p = F.least(2 * end, F.lit(1.0)) if asked.window == "any_time" else end
    return held.select(KEY, "at", F.round(p * D.FULL).cast("bigint").alias("rate"))


def _said(s: DataFrame, asked: Asked) -> DataFrame:
    """(series_id, at, stated, outcome): a row for each moment of the grid; ``stated`` is null where no way can say anything."""
    ways, ahead, every = asked.ways(), asked.days * DAY, asked.every_days * DAY
    points = kept(_points(s, asked), "points")
    ends = points.groupBy(KEY).agg((F.min("t") + every).alias("lo"), (F.max("t") - ahead).alias("hi")).where("lo <= hi")
    grid = ends.select(KEY, F.explode(F.sequence("lo", "hi", F.lit(every))).alias("at"))
    back = [d for kind, d in ways if kind == "often" and d]
    tags = F.array(F.struct(F.lit("now").alias("tag"), F.col("at").alias("t")), F.struct(F.lit("end").alias("tag"), (F.col("at") + ahead).alias("t")), *(F.struct(F.lit(str(d)).alias("tag"), (F.col("at") - d * DAY - 1).alias("t")) for d in back))
    grid = kept(grid, "moments")
    found = _looked_up(points, grid.select(KEY, "at", F.explode(tags).alias("x")).select(KEY, "at", "x.tag", "x.t"))
    at_tag = lambda tag: F.max_by("p", F.when(F.col("tag") == tag, 1))
    held = found.groupBy(KEY, "at").agg(at_tag("now").alias("now"), *(at_tag(str(d)).alias(f"back{d}") for d in back))
    held = kept(held, "known")
    # stretches count as far as the history known covers them
    covered = _looked_up(points, held.select(KEY, "at", F.lit("covered").alias("tag"), (F.col("now.t") - ahead).alias("t")))
    held = held.join(covered.select(KEY, "at", F.col("p").alias("past")), [KEY, "at"])
    after = points.select(KEY, F.col("t"), "v", F.lit(None).cast("bigint").alias("at")).unionByName(grid.select(KEY, F.col("at").alias("t"), F.lit(None).cast("double").alias("v"), "at"))
    # a moment that falls on a point stands behind it; windows by time leave both out
    after = after.withColumns(_look_ahead("t", ahead)).where("at IS NOT NULL").select(KEY, "at", "last", "high", "low", "after")
    held = held.join(after, [KEY, "at"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    rates = []
    for kind, days in ways:
        if kind == "often":
            less = (zero(F.col(f"back{days}.c")), zero(F.col(f"back{days}.h"))) if days else (F.lit(0), F.lit(0))
            n, h = (F.greatest(zero(F.col(f"past.{x}")) - y, F.lit(0).cast("bigint")) for x, y in zip("ch", less, strict=True))
            rates.append(D.base_rate(h, n))
        elif kind == "swings":
            held = held.join(_swings(points, grid, days, asked).withColumnRenamed("rate", f"swings{days}"), [KEY, "at"], "left")
            rates.append(F.col(f"swings{days}"))
        else:
            k, now = f"{kind}{days}", F.col(f"now.{kind}{days}")
            n, h = (reduce(lambda acc, sign, k=k, x=x, now=now: acc.when(now == sign, zero(F.col(f"past.`{k}_{x}{sign}`"))), SIGNS[1:], F.when(now == SIGNS[0], zero(F.col(f"past.`{k}_{x}{SIGNS[0]}`")))) for x in "ch")
            rates.append(D.base_rate(h, n))
    said = [f"said{i}" for i in range(len(rates))]
    held = kept(held.select(KEY, "at", F.col("now.v").alias("v"), "last", "high", "low", "after", *(r.alias(n) for r, n in zip(rates, said, strict=True))), "rates")
    known = F.coalesce(F.col("v") != 0, F.lit(False))
    likely = [F.when(known, D.as_forecast(F.col(n))) for n in said]
    stated = F.when(F.coalesce(*likely).isNotNull(), F.array(*(F.coalesce(x, F.lit(5000).cast("bigint")) for x in likely)))
    satisfied = F.when(known & (F.col("after") > 0), asked.held(F.col("v"), F.col("last"), F.col("high"), F.col("low")))
    return held.select(KEY, "at", stated.alias("stated"), satisfied.alias("outcome"))


def moments(s: DataFrame, asked: Asked) -> DataFrame:
    """(series_id, time, way, said_bps, came_true): a row for each way at each moment that counts. Ways are numbered as tried;
    those behind ``asked.ways()`` are the same ones read through their own record of what had settled by then. A way that
    can say nothing says 50 %; moments where none can, or whose outcome is void, are left out."""
    return _read(_said(s, asked), asked).select(KEY, F.timestamp_micros("at").alias(TIME), "way", "said_bps", "came_true")


def _read(said: DataFrame, asked: Asked) -> DataFrame:
    base = len(asked.ways())
    told = said.where("stated IS NOT NULL AND outcome IS NOT NULL").select(KEY, "at", F.col("outcome").alias("came_true"), F.posexplode("stated").alias("way", "said_bps"))
    settled = Window.partitionBy(KEY, "way", D.tenth(F.col("said_bps"))).orderBy("at").rangeBetween(Window.unboundedPreceding, -asked.days * DAY)
    zero = F.lit(0).cast("bigint")
    came, scored = F.coalesce(F.sum(F.col("came_true").cast("bigint")).over(settled), zero), F.count("*").over(settled)
    read = told.withColumn("r", D.as_forecast(D.recalibrated(F.col("said_bps"), came, scored, COUNTS_AS)))
    both = F.array(F.struct(F.col("way"), F.col("said_bps")), F.struct((F.col("way") + base).alias("way"), F.col("r").alias("said_bps")))
    return read.select(KEY, "at", "came_true", F.explode(both).alias("x")).select(KEY, "at", F.col("x.way").alias("way"), F.col("x.said_bps").alias("said_bps"), "came_true")


def _mean(total: Column, n: Column) -> Column:
    return D.floor_div(total, F.greatest(n, F.lit(1)))


def trial(s: DataFrame, asked: Asked) -> tuple[DataFrame, DataFrame]:
    """(report, stretches). The moments of a series are cut into one stretch more than asked; the way that did best on what had
    settled before a stretch is chosen and tested on it.

    report: series_id, moments, left_out, from, to, tested, came_true, chosen_bps, each_bps, even_bps, calibration (tenth,
    forecasts, said_bps, came_true). stretches: series_id, stretch, from, to, learned_from, learned_bps, chosen, tested,
    came_true, chosen_bps, each_bps, even_bps. Scores are mean Brier scores in basis points; always saying 50 % scores 2500.
    Series whose moments do not reach for the stretches are refused with TOO_SHORT."""
    k, ahead = asked.stretches, asked.days * DAY
    said = kept(_said(s, asked), "said")
    told = _read(said, asked).withColumn("brier", D.brier(F.col("said_bps"), F.col("came_true")))
    by_time = Window.partitionBy(KEY).orderBy("at")
    once = told.where("way = 0").select(KEY, "at", (F.row_number().over(by_time) - 1).alias("i"), F.count("*").over(Window.partitionBy(KEY)).alias("n"))
    cut = lambda j: D.floor_div(F.lit(j).cast("bigint") * F.col("n"), k + 1)
    # stretch j holds the moments from cut(j) on; the first one is only learned from
    placed = once.withColumn("stretch", reduce(lambda acc, j: acc + (F.col("i") >= cut(j)).cast("int"), range(1, k + 1), F.lit(0)))
    spans = placed.groupBy(KEY, "stretch").agg(F.min("at").alias("begins"), F.max("at").alias("ends"), F.count("*").alias("tested"), F.max("n").alias("n"))
    heads = spans.groupBy(KEY).agg(F.max("n").alias("n"), F.min("begins").alias("first"), F.min(F.when(F.col("stretch") == 1, F.col("begins"))).alias("second"))
    short = (F.col("n") < (k + 1) * PER_STRETCH) | (F.col("first") + ahead > F.col("second"))
    ready = heads.select(KEY, refuse_when(short, "TOO_SHORT", f"the history does not reach for {k} stretches of {PER_STRETCH} moments and what comes before them", F.col("n")).alias("moments"))
    told = kept(told.join(placed.select(KEY, "at", "stretch"), [KEY, "at"]), "told")
    tests = spans.where("stretch > 0").select(KEY, F.col("stretch").alias("test"), "begins")
    learned = told.join(tests, KEY).where((F.col("stretch") < F.col("test")) & (F.col("at") + ahead <= F.col("begins")))
    totals = learned.groupBy(KEY, F.col("test").alias("stretch"), "way").agg(F.sum("brier").alias("total"), F.count("*").alias("learned_from"))
    chosen = totals.groupBy(KEY, "stretch").agg(
        F.min(F.struct("total", "way")).alias("best"), F.max("learned_from").alias("learned_from"), F.array_sort(F.collect_list(F.struct("way", _mean(F.col("total"), F.col("learned_from")).alias("bps")))).alias("l")
    )  # a number for each way
    chosen = chosen.select(KEY, "stretch", F.col("best.way").alias("chosen"), "learned_from", F.col("l.bps").alias("learned_bps"))
    tried = told.where("stretch > 0").join(chosen.select(KEY, "stretch", "chosen"), [KEY, "stretch"])
    even = D.brier(F.lit(5000), F.col("came_true"))
    own = F.col("way") == F.col("chosen")

    def scores(by: list[str]) -> DataFrame:
        each = tried.groupBy(*by, "way").agg(F.sum("brier").alias("b"), F.count("*").alias("n"), F.count_if("came_true").alias("c"), F.sum(even).alias("e"), F.sum(F.when(own, F.col("brier"))).alias("own"))
        out = each.groupBy(*by).agg(F.max("n").alias("tested"), F.max("c").alias("came_true"), F.sum("own").alias("own"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("way", _mean(F.col("b"), F.col("n")).alias("bps")))).alias("l"))
        n = F.col("tested")
        return out.select(*by, "tested", "came_true", _mean(F.col("own"), n).alias("chosen_bps"), F.col("l.bps").alias("each_bps"), _mean(F.col("e"), n).alias("even_bps"))

    stamp = lambda c: F.timestamp_micros(c)
    stretches = spans.select(KEY, "stretch", stamp("begins").alias("from"), stamp("ends").alias("to")).join(chosen, [KEY, "stretch"]).join(scores([KEY, "stretch"]), [KEY, "stretch"]).join(ready.select(KEY), KEY, "left_semi")
    tenths = tried.where(own).groupBy(KEY, D.tenth(F.col("said_bps")).alias("tenth")).agg(F.count("*").alias("forecasts"), F.sum("said_bps").alias("sum"), F.count_if("came_true").alias("came_true"))
    tenths = tenths.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("tenth", "forecasts", D.floor_div(F.col("sum"), F.col("forecasts")).alias("said_bps"), "came_true"))).alias("calibration"))
    left = said.groupBy(KEY).agg(F.count_if(F.col("stated").isNull() | F.col("outcome").isNull()).alias("left_out"))
    span = spans.groupBy(KEY).agg(stamp(F.min("begins")).alias("from"), stamp(F.max("ends")).alias("to"))
    report = ready.join(left, KEY).join(span, KEY).join(scores([KEY]), KEY, "left").join(tenths, KEY, "left")
    return report, stretches
