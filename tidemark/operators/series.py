"""Time series as DataFrames (series_id, time, value): many series side by side, each handled by its key.

Steps are windows and aggregations by ``series_id``, so work spreads over as many tasks as there are series; nothing is
collected. Points that a step leaves undefined are dropped, never null or NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..errors import Refused, choice, refuse_when, whole
from ..functions.linear import solve_spd
from . import halo

KEY, TIME, VALUE = "series_id", "time", "value"
UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def _by_time():
    return Window.partitionBy(KEY).orderBy(TIME)


def series(df: DataFrame, time: str | Column, value: str | Column, series_id: str | Column | None = None) -> DataFrame:
    """Any table as series; without ``series_id`` it is one series named ``all``."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    key = F.lit("all") if series_id is None else as_col(series_id).cast("string")
    return df.select(key.alias(KEY), as_col(time).cast("timestamp").alias(TIME), as_col(value).cast("double").alias(VALUE))


def check(s: DataFrame, pos: str | None = None) -> DataFrame:
    """``s`` itself, once one pass has shown that times are there and distinct within a series and values finite; with
    ``pos``, a column that numbers rows, also that times rise with it."""
    bad = F.col(TIME).isNull() | F.col(VALUE).isNull() | F.isnan(VALUE) | (F.abs(VALUE) == float("inf"))
    first = s.where(bad).limit(1).collect() or s.groupBy(KEY, TIME).count().where("count > 1").limit(1).collect()
    if not first and pos:
        order = Window.partitionBy(KEY).orderBy(pos)
        first = s.withColumn("__before", F.lag(TIME).over(order)).where(F.col("__before") >= F.col(TIME)).limit(1).collect()
    if first:
        raise Refused("NOT_A_SERIES", f"times must rise and values be finite: {first[0].asDict()}", "series")
    return s


def sound(s: DataFrame) -> DataFrame:
    """``s``, whose query fails with NOT_A_SERIES where a time or value is missing or a value is not finite. Every step asks for
    it; nothing is read for it alone."""
    bad = F.col(TIME).isNull() | F.col(VALUE).isNull() | F.isnan(VALUE) | (F.abs(VALUE) == float("inf"))
    return s.withColumn(VALUE, refuse_when(bad, "NOT_A_SERIES", "times must be there and values finite", F.col(VALUE)))


def _stepped(s: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """``sound``, and refused too where two values of a series have one time; for steps that sort by time anyway."""
    again = F.coalesce(F.lag(TIME).over(w or _by_time()) == F.col(TIME), F.lit(False))
    return sound(s).withColumn(VALUE, refuse_when(again, "NOT_A_SERIES", "times must differ within a series", F.col(VALUE)))


def _by_row(s: DataFrame, back: int, long: bool, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``s`` with columns of windows that reach ``back`` rows back. A series is one task, or, where it is ``long``, as many as
    Spark makes ranges of it."""
    if not long:
        w = _by_time()
        return _stepped(s, w).withColumns(columns(w))
    rows, w = halo.ranged(s.select(KEY, TIME, VALUE), max(back, 1))
    return _stepped(rows, w).withColumns(columns(w)).where(~F.col(halo.BORROWED)).drop(halo.RANGE, halo.BORROWED)


def distinct(s: DataFrame) -> DataFrame:
    """``sound``, and refused where two values of a series have one time: one row for each instant, counted. For steps that
    aggregate or join by instant; a join by instant needs no further shuffle."""
    one = sound(s).groupBy(KEY, TIME).agg(F.count("*").alias("__n"), F.any_value(VALUE).alias(VALUE))
    return one.select(KEY, TIME, refuse_when(F.col("__n") > 1, "NOT_A_SERIES", "times must differ within a series", F.col(VALUE)).alias(VALUE))


def resample(s: DataFrame, every: str, aggregate: str = "last") -> DataFrame:
    """One point per calendar period (weeks start on Monday), at the last instant observed in it; gaps stay gaps."""
    unit = UNITS[choice(every, UNITS, "every")]
    how = {"last": F.max_by(VALUE, TIME), "mean": F.avg(VALUE), "sum": F.sum(VALUE)}
    value = how[choice(aggregate, how, "aggregate")]
    return distinct(s).groupBy(KEY, F.date_trunc(unit, TIME).alias("__p")).agg(F.max(TIME).alias(TIME), value.alias(VALUE)).drop("__p")


def change(s: DataFrame, how: str = "percent", over: int = 1, long: bool = False) -> DataFrame:
    """Percent (times 100), log or difference against the value ``over`` rows before. ``long``: for series of more rows than a
    task should take, as in ``lag`` and ``rolling``."""
    choice(how, ("percent", "log", "difference"), "how")
    held = _by_row(s, whole(over, "over"), long, lambda w: {"__b": F.lag(VALUE, over).over(w)}).where("__b IS NOT NULL")
    v, b = F.col(VALUE), F.col("__b")
    new = {
        "percent": F.when(b != 0, (v / F.nullif(b, F.lit(0.0)) - 1) * 100),
        "log": F.when((b > 0) & (v > 0), F.log(v / F.nullif(b, F.lit(0.0)))),
        "difference": v - b,
    }[how]
    return held.select(KEY, TIME, new.alias(VALUE)).where(F.col(VALUE).isNotNull())


def lag(s: DataFrame, by: int, long: bool = False) -> DataFrame:
    """Each instant with the value ``by`` rows before; the first ``by`` instants go."""
    held = _by_row(s, whole(by, "by"), long, lambda w: {"__b": F.lag(VALUE, by).over(w)})
    return held.select(KEY, TIME, F.col("__b").alias(VALUE)).where(F.col(VALUE).isNotNull())


def rolling(s: DataFrame, window: int, statistic: str = "mean", periods_per_year: float | None = None, long: bool = False) -> DataFrame:
    """mean, sd (sample), zscore of the last value, or vol (sd times the root of ``periods_per_year``) of full windows; flat
    windows have no z-score."""
    choice(statistic, ("mean", "sd", "zscore", "vol"), "statistic")
    whole(window, "window", 2)
    if (statistic == "vol") != (periods_per_year is not None) or (periods_per_year is not None and periods_per_year <= 0):
        raise Refused("NOT_DEFINED", "vol needs periods_per_year above 0, and only vol takes it", "periods_per_year")
    def columns(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-(window - 1), 0)
        return {"__n": F.count("*").over(w), "__m": F.avg(VALUE).over(w), "__s": F.stddev_samp(VALUE).over(w)}

    held = _by_row(s, window - 1, long, columns).where(F.col("__n") == window)
    new = {
        "mean": F.col("__m"),
        "sd": F.col("__s"),
        "zscore": F.when(F.col("__s") > 0, (F.col(VALUE) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))),
        "vol": F.col("__s") * F.sqrt(F.lit(float(periods_per_year or 0))),
    }[statistic]
    return held.select(KEY, TIME, new.alias(VALUE)).where(F.col(VALUE).isNotNull())


def align(*many: DataFrame) -> DataFrame:
    """(series_id, time, values): instants that all series share; values in the order given."""
    if len(many) < 2:
        raise Refused("TOO_FEW_SERIES", "align takes two series or more", "series")
    named = [distinct(x).select(KEY, TIME, F.col(VALUE).alias(f"__v{i}")) for i, x in enumerate(many)]
    joined = reduce(lambda a, b: a.join(b, [KEY, TIME]), named)
    return joined.select(KEY, TIME, F.array(*(f"__v{i}" for i in range(len(many)))).alias("values"))


def _pair(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(a).select(KEY, TIME, F.col(VALUE).alias("a")).join(distinct(b).select(KEY, TIME, F.col(VALUE).alias("b")), [KEY, TIME])


def combine(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """add, subtract, multiply or divide on shared instants; points divided by zero go."""
    x, y = F.col("a"), F.col("b")
    ops = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.when(y != 0, x / F.nullif(y, F.lit(0.0)))}
    new = ops[choice(operation, ops, "operation")]
    return _pair(a, b).select(KEY, TIME, new.alias(VALUE)).where(F.col(VALUE).isNotNull())


def keep(s: DataFrame, side: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) points: above, below, at_least or at_most ``threshold``."""
    v = F.col(VALUE)
    tests = {"above": v > threshold, "below": v < threshold, "at_least": v >= threshold, "at_most": v <= threshold}
    test, s = tests[choice(side, tests, "keep")], sound(s)
    return s.where(test), s.where(~test)


def summarize(s: DataFrame, what: str) -> DataFrame:
    """One number per series: last, first, mean, stdev, min, max or count."""
    n = F.count(VALUE)  # of values, so that their refusal is not pruned away
    how = {
        "last": F.max_by(VALUE, TIME), "first": F.min_by(VALUE, TIME), "mean": F.avg(VALUE), "min": F.min(VALUE), "max": F.max(VALUE), "count": n.cast("double"),
        "stdev": refuse_when(n < 2, "NOT_DEFINED", "a standard deviation needs two points", F.stddev_samp(VALUE)),
    }
    return distinct(s).groupBy(KEY).agg(how[choice(what, how, "summary")].alias(VALUE))


def describe(s: DataFrame) -> DataFrame:
    """count, from, to, first, last, mean, sd (null for one point), min, max of each series."""
    return distinct(s).groupBy(KEY).agg(
        F.count(VALUE).alias("count"), F.min(TIME).alias("from"), F.max(TIME).alias("to"), F.min_by(VALUE, TIME).alias("first"), F.max_by(VALUE, TIME).alias("last"),
        F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("sd"), F.min(VALUE).alias("min"), F.max(VALUE).alias("max"),
    )


def correlate(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, correlation, n): Pearson on shared instants; under three of them, or a constant side, is refused."""
    held = _pair(a, b).groupBy(KEY).agg(F.count("*").alias("n"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), F.covar_samp("a", "b").alias("c"))
    bad = (F.col("n") < 3) | (F.col("sa") == 0) | (F.col("sb") == 0)
    flat = F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0))
    return held.select(KEY, refuse_when(bad, "NOT_DEFINED", "correlation needs three shared instants and two sides that vary", F.col("c") / flat).alias("correlation"), "n")


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(n: pd.Series, means: pd.Series, moments: pd.Series) -> pd.Series:
    """intercept, slopes, r squared, residual deviation from sample moments; null where they do not determine them. Pivots of
    the centred products are those of the normal equations behind the intercept's."""
    rows = n.to_numpy()
    if not len(rows):
        return pd.Series([], dtype=object)
    mean = np.stack(means.to_numpy()).astype(float)
    k = mean.shape[1]
    product = np.stack(moments.to_numpy()).astype(float).reshape(-1, k, k) * (rows - 1)[:, None, None]
    squares = np.diagonal(product, axis1=1, axis2=2) + rows[:, None] * mean**2
    scale = np.maximum(np.maximum(squares[:, 1:].max(axis=1), rows), 1.0)
    slopes, good = solve_spd(product[:, 1:, 1:], product[:, 1:, 0], scale)
    total = product[:, 0, 0]
    good &= (rows >= k + 1) & (total > 0)
    rest = np.maximum(total - (slopes * product[:, 1:, 0]).sum(axis=1), 0.0)
    with np.errstate(all="ignore"):
        out = np.column_stack([mean[:, 0] - (slopes * mean[:, 1:]).sum(axis=1), slopes, 1 - rest / total, np.sqrt(rest / (rows - k))])
    return pd.Series([list(x) if fits else None for x, fits in zip(out, good, strict=True)], dtype=object)


def regress(y: DataFrame, *xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least squares with intercept on the instants that all share: (coefficients, residual series).

    One aggregation gathers means and covariances - (k + 1)^2 numbers a series - and the small solve runs where they are.
    Too few instants (under k + 2), constant or collinear regressors and a constant y are refused.
    """
    if not xs:
        raise Refused("REGRESSOR_REQUIRED", "regress takes one regressor or more", "regressors")
    k = len(xs)
    table = align(y, *xs).select(KEY, TIME, *(F.get("values", F.lit(i)).alias(f"v{i}") for i in range(k + 1)))
    v = [f"v{i}" for i in range(k + 1)]
    moments = table.groupBy(KEY).agg(F.count("*").alias("observations"), F.array(*map(F.avg, v)).alias("m"), F.array(*(F.covar_samp(p, q) for p in v for q in v)).alias("c"))
    solved = moments.select(KEY, "observations", _solve("observations", "m", "c").alias("b"))
    got = solved.select(KEY, "observations", refuse_when(F.col("b").isNull(), "NOT_DEFINED", "too few instants, collinear regressors, or a constant series", F.col("b")).alias("b"))
    out = got.select(KEY, F.get("b", F.lit(0)).alias("alpha"), F.slice("b", 2, k).alias("betas"), F.get("b", F.lit(k + 1)).alias("r_squared"), F.get("b", F.lit(k + 2)).alias("residual_std"), "observations")
    fitted = reduce(lambda acc, i: acc + F.get("betas", F.lit(i)) * F.col(f"v{i + 1}"), range(k), F.col("alpha"))
    residuals = table.join(out.select(KEY, "alpha", "betas"), KEY).select(KEY, TIME, (F.col("v0") - fitted).alias(VALUE))
    return out, residuals


def carried(df: DataFrame, bucket: str, end: Column, name: str) -> DataFrame:
    """``df`` with ``__b``, the calendar unit of a row's time, and ``name``: the last ``end`` - an aggregate of a unit - of the
    units before it. A long series is handled unit by unit; only a row for each unit is ordered as a whole."""
    df = df.withColumn("__b", F.date_trunc(bucket, TIME))
    ends = df.groupBy(KEY, "__b").agg(end.alias("__e"))
    before = Window.partitionBy(KEY).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(ends.select(KEY, "__b", F.last("__e", ignorenulls=True).over(before).alias(name)), [KEY, "__b"])


def as_of(left: DataFrame, right: DataFrame, bucket: str = "month") -> DataFrame:
    """``left`` (series_id, time, ...) with ``as_of_time`` and ``as_of_value``: the right series' last point at or before each
    time (null before the first). A union sorted by series and ``bucket``, not a range join; what the months before leave
    behind is carried from one row for each."""
    cols = [c for c in left.columns if c not in (KEY, TIME)]
    a = left.select(KEY, TIME, F.lit(1).alias("__side"), F.struct(*cols).alias("__l") if cols else F.struct(F.lit(None).alias("x")).alias("__l"), F.lit(None).cast("struct<t:timestamp,v:double>").alias("__r"))
    b = sound(right).select(KEY, TIME, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(F.col(TIME).alias("t"), F.col(VALUE).alias("v")).alias("__r"))
    held = carried(a.unionByName(b), bucket, F.max("__r"), "__c")
    w = Window.partitionBy(KEY, "__b").orderBy(TIME, "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__r", F.coalesce(F.last("__r", ignorenulls=True).over(w), "__c")).where("__side = 1")
    return held.select(KEY, TIME, *(F.col(f"__l.`{c}`").alias(c) for c in cols), F.col("__r.t").alias("as_of_time"), F.col("__r.v").alias("as_of_value"))
