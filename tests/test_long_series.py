"""Windows over ranges of one long series equal the plain ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import halo, paths, series

SCHEMA = "series_id string, time timestamp, value double"


@pytest.fixture(scope="module")
def mixed(spark):
    """One long series among short ones."""
    r = random.Random(3)
    start = dt.datetime(2030, 1, 1)
    rows = [("long", start + dt.timedelta(hours=i), r.uniform(1, 9)) for i in range(4_000)]
    rows += [(f"s{k}", start + dt.timedelta(hours=i), r.uniform(1, 9)) for k in range(30) for i in range(k % 7)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def points(df):
    return {(r.series_id, r.time): pytest.approx(r.value, rel=1e-9, abs=1e-12) for r in df.collect()}


@pytest.mark.parametrize("ranges", [3, 40])
@pytest.mark.parametrize("back", [1, 5, 300])
def test_ranges_borrow_what_they_need(spark, mixed, ranges, back):
    rows, _ = halo.ranged(mixed, back, ranges)
    held = [tuple(r) for r in rows.select("__range", "__borrowed", "series_id", "time").collect()]
    own = sorted((n, k, t) for n, b, k, t in held if not b)
    assert sorted((k, t) for _, k, t in own) == sorted((r.series_id, r.time) for r in mixed.collect())
    order = [(k, t) for _, k, t in own]  # ranges in order, rows in order in them
    assert order == sorted(order)
    for n in {x[0] for x in own}:
        first = next(i for i, x in enumerate(own) if x[0] == n)
        assert sorted((k, t) for m, b, k, t in held if b and m == n) == order[max(0, first - back) : first]
    assert max(sum(1 for x in held if x[0] == n) for n in {x[0] for x in own}) <= len(own) / ranges * 2.5 + back


@pytest.mark.parametrize(
    "step",
    [
        lambda s, long: series.change(s, "percent", 1, long), lambda s, long: series.change(s, "log", 150, long), lambda s, long: series.lag(s, 3, long), lambda s, long: series.rolling(s, 200, "mean", long=long),
        lambda s, long: series.rolling(s, 7, "zscore", long=long), lambda s, long: series.rolling(s, 2, "vol", 252.0, long), lambda s, long: paths.returns(s, "simple", long), lambda s, long: paths.returns(s, "log", long),
    ],
)
def test_long_steps(spark, mixed, step):
    plain, apart = points(step(mixed, False)), step(mixed, True).collect()
    assert len(apart) == len(plain) > 3_500
    assert all(plain[(r.series_id, r.time)] == r.value for r in apart)


def test_long_steps_refuse(spark, mixed):
    again = mixed.union(mixed.where("series_id = 'long'").orderBy("time").limit(1))
    with pytest.raises(Exception, match="NOT_A_SERIES"):
        series.change(again, long=True).collect()
    assert series.lag(mixed.limit(0), 2, long=True).count() == 0


def test_excess_is_the_plain_recursion(spark):
    r = random.Random(4)
    start, rows, rates, want = dt.datetime(2030, 1, 1), [], [], {}
    for name, n in (("a", 900), ("b", 2), ("c", 40)):
        times = sorted(r.sample(range(40_000), n))
        prices = [r.uniform(0.5, 1.5) if name != "c" else r.choice([0.01, 5.0]) for _ in times]  # c: factors below 0 too
        yearly = [r.uniform(-3, 9) if name != "c" else r.choice([0.0, 4e5]) for _ in times]
        value = prices[0]
        for i, t in enumerate(times):
            if i:
                earned = (1 + yearly[i - 1] / 100) ** ((t - times[i - 1]) * 3600 / (365.25 * 86400)) - 1
                value *= 1 + (prices[i] / prices[i - 1] - 1) - earned
            at = start + dt.timedelta(hours=t)
            want[(name, at)] = value
            rows.append((name, at, prices[i]))
            rates.append((name, at, yearly[i]))
    rates.append(("a", start + dt.timedelta(hours=50_000), 1.0))  # an instant that only one has
    path, rate = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rates, SCHEMA)
    for bucket in ("day", "month", "year"):
        got = {(x.series_id, x.time): x.value for x in paths.excess(path, rate, bucket=bucket).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-300) for k, v in want.items())
    for bad in (path.withColumn("value", -F.col("value")), path.where("series_id = 'b'").limit(1)):
        with pytest.raises(Exception, match="NOT_DEFINED"):
            paths.excess(bad, rate).collect()


def test_ranks_by_digits(spark):
    """Heavy tails, ties, signs and one value far off, against numpy."""
    import numpy as np

    r = np.random.default_rng(5)
    many = {
        "tails": r.standard_cauchy(3_000) * 1e3, "outlier": np.append(r.random(2_000), 1e300), "ties": r.integers(-3, 3, 2_000) * 1.0, "zeros": np.array([0.0, -0.0, 0.0, -1e-320, 1e-320]), "one": np.array([7.5]),
        "same": np.full(1_000, 2.5), "signs": np.array([-1e308, 1e308, -1.0, 1.0, -5e-324]),
    }
    rows = [(k, dt.datetime(2030, 1, 1) + dt.timedelta(minutes=i), float(v)) for k, x in many.items() for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for share in (0.0, 0.05, 0.5, 0.99, 1.0):
        got = {x.series_id: x.q for x in paths.quantile(s, share).collect()}
        assert got.keys() == many.keys()
        for k, x in many.items():
            y = np.sort(x)
            at = (len(y) - 1) * share
            lo = int(at)
            assert got[k] == pytest.approx(y[lo] + (at - lo) * (y[min(lo + 1, len(y) - 1)] - y[lo]), rel=1e-12, abs=1e-330), (k, share)
    ranks = spark.createDataFrame([("tails", 17), ("tails", 2_999), ("outlier", 2_000), ("ties", 0)], "series_id string, rank bigint")
    assert {(x.series_id, x.rank): x.value for x in paths.ranked(s, ranks).collect()} == {(k, i): float(np.sort(many[k])[i]) for k, i in (("tails", 17), ("tails", 2_999), ("outlier", 2_000), ("ties", 0))}
