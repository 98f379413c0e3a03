"""Whole numbers of any size, and the tests and splits that stand on them, against Python's integers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.operators import forecasts


def value(limbs):
    return None if limbs is None else sum(v * exact.BASE**i for i, v in enumerate(limbs))


def test_arithmetic(spark):
    r = random.Random(3)
    edge = [0, 1, -1, exact.BASE, -exact.BASE, exact.BASE - 1, 2**62, -(2**62)]
    rows = [(a, b, 7) for a in edge for b in edge] + [(r.randint(-(10**18), 10**18), r.randint(-(10**18), 10**18), r.randint(1, 10**10)) for _ in range(100)] + [(None, 5, 1)]
    a, b = exact.number(F.col("a")), exact.number(F.col("b"))
    cube = exact.times(a, b, a, b, a)
    got = spark.createDataFrame(rows, "a bigint, b bigint, k bigint").select("a", "b", "k", exact.plus(a, b, 3).alias("p"), exact.minus(a, b).alias("m"), cube.alias("t"), exact.less(a, b).alias("l"), exact.over(exact.times(a, a), F.col("k")).alias("o")).collect()
    for x in got:
        if x.a is None:
            assert (x.p, x.m, x.t, x.l, x.o) == (None,) * 5
            continue
        assert (value(x.p), value(x.m), value(x.t), x.l) == (x.a + 3 * x.b, x.a - x.b, x.a**3 * x.b**2, x.a < x.b)
        assert x.o == x.a**2 // x.k


def test_beyond_chance(spark):
    r = random.Random(4)
    rows = [(5, 10_000, 20_000_000, 5, 10_000, 20_000_000), (4, 0, 0, 10**9, 10**13, 10**17), (10**9, 10**13, 10**17, 10**9, 0, 0)]
    for _ in range(300):
        n1, n2 = (r.choice([r.randint(1, 40), r.randint(1, 10**9)]) for _ in range(2))
        m = r.randint(0, 9_900)
        s1, s2 = n1 * m + r.randint(0, n1), n2 * (m + r.choice([0, 0, 1, 90])) + r.randint(0, 2 * n2)
        rows.append((n1, s1, -(-s1 * s1 // n1) + r.randint(0, n1 * 40), n2, s2, -(-s2 * s2 // n2) + r.randint(0, n2 * 40)))
    names = ["n1", "s1", "q1", "n2", "s2", "q2"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    got = df.select(*names, forecasts.apart(*map(F.col, names)).alias("apart"), forecasts.paired(F.col("n1"), F.col("s1") - F.col("s2"), F.col("q1")).alias("paired")).collect()
    seen = set()
    for x in got:
        n1, s1, q1, n2, s2, q2 = x[:6]
        d = s1 * n2 - s2 * n1
        spread = n2 * n2 * (n2 - 1) * (n1 * q1 - s1 * s1) + n1 * n1 * (n1 - 1) * (n2 * q2 - s2 * s2)
        assert x.apart == (n1 >= 5 and n2 >= 5 and 4 * spread < d * d * (n1 - 1) * (n2 - 1))
        e = s1 - s2
        assert x.paired == (n1 >= 5 and 4 * (n1 * q1 - e * e) < e * e * (n1 - 1))
        seen.add(x.apart)
    assert seen == {True, False}


def test_sureness(spark):
    r = random.Random(5)
    rows = [(4, 4, 0, 0), (5, 5, 0, 0), (5, 0, 50_000, 0), (100, 50, 500_000 + 10_000, 25 * 10**6), (100, 50, 500_000 + 10_001, 25 * 10**6)]
    rows += [(n := r.randint(5, 10**9), c := r.randint(0, n), max(0, 10_000 * c + r.randint(-(10**9), 10**9)), r.randint(0, 25 * 10**6 * n)) for _ in range(200)]
    got = spark.createDataFrame(rows, "n bigint, came bigint, said bigint, spread bigint").select("*", forecasts.sureness(*map(F.col, ["n", "came", "said", "spread"])).alias("is")).collect()
    for n, came, said, spread, told in got:
        d = said - 10_000 * came
        assert told == ("untold" if n < 5 else "about" if 4 * spread >= d * d else "too_high" if d > 0 else "too_low")


def test_split(spark):
    r = random.Random(6)
    rows = [(k, p := r.choice([0.0, 0.1234, 0.5, 0.7, 1.0]), r.random() < p) for k in "abc" for _ in range({"a": 1, "b": 60, "c": 3000}[k])]
    got = {x.k: x for x in forecasts.split(spark.createDataFrame(rows, "k string, probability double, came_true boolean"), "k").collect()}
    for k in "abc":
        groups: dict[int, list[int]] = {}
        for _, p, c in (x for x in rows if x[0] == k):
            g = groups.setdefault(round(p * 10_000), [0, 0])
            g[0] += 1
            g[1] += c
        n, o = (sum(g[i] for g in groups.values()) for i in (0, 1))
        want = (
            sum(c * (10_000 - p) ** 2 + (m - c) * p * p for p, (m, c) in groups.items()) // n // 10_000,
            sum((m * p - 10_000 * c) ** 2 // m for p, (m, c) in groups.items()) // n // 10_000,
            sum(10_000 * (n * c - m * o) ** 2 // m for m, c in groups.values()) // n**3,
            10_000 * o * (n - o) // n**2,
        )
        x = got[k]
        assert (x.n, x.total, x.off_by, x.told_apart, x.how_hard) == (n, *want)
        assert x.calibrated == (want[1] <= 100) and x.discerning == (0 < want[3] <= 4 * want[2])
    assert forecasts.split(spark.createDataFrame([], "k string, probability double, came_true boolean"), "k").count() == 0
