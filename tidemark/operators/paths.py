"""Measures of price paths: one row per series. Returns are fractions, deviations sample ones, a year has 365.25 days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused, choice, refuse_when
from ..functions.text import bound
from ..scratch import held
from .series import KEY, TIME, VALUE, _by_row, _by_time, _pair, carried, sound

YEAR_S = 365.25 * 86400
SHIFTS = (42, 21, 0)


def returns(path: DataFrame, kind: str = "simple", long: bool = False) -> DataFrame:
    """Simple or log returns of prices above 0; the first instant goes. ``long``: for paths of more rows than a task should
    take."""
    choice(kind, ("simple", "log"), "kind")
    before = F.col("__b")
    ratio = F.when((before > 0) & (F.col(VALUE) > 0), F.col(VALUE) / F.nullif(before, F.lit(0.0)))
    r = ratio - 1 if kind == "simple" else F.log(ratio)
    held = _by_row(path, 1, long, lambda w: {"__b": F.lag(VALUE).over(w)}).where("__b IS NOT NULL").select(KEY, TIME, r.alias(VALUE))
    return held.select(KEY, TIME, refuse_when(F.col(VALUE).isNull(), "NOT_DEFINED", "prices must be above 0", F.col(VALUE)).alias(VALUE))


def growth(path: DataFrame) -> DataFrame:
    """(series_id, total_return, cagr)."""
    held = sound(path).groupBy(KEY).agg(F.min_by(VALUE, TIME).alias("f"), F.max_by(VALUE, TIME).alias("l"), F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    total = F.col("l") / F.nullif(F.col("f"), F.lit(0.0)) - 1
    years = (F.unix_micros("b") - F.unix_micros("a")) / (1e6 * YEAR_S)
    bad = (F.col("f") <= 0) | (years <= 0)
    return held.select(KEY, refuse_when(F.col("f") <= 0, "NOT_DEFINED", "a path starts above 0", total).alias("total_return"), refuse_when(bad, "NOT_DEFINED", "growth a year needs a positive start and span", F.pow(1 + total, 1 / F.nullif(years, F.lit(0.0))) - 1).alias("cagr"))


def drawdown(path: DataFrame, bucket: str = "year") -> DataFrame:
    """(series_id, depth, peak_time, trough_time): the deepest fall from a running peak; of equal ones the first. Peaks run within
    a ``bucket``, and the highest of the buckets before it is carried over."""
    top = F.struct(VALUE, (-F.unix_micros(TIME)).alias("t"))
    ends = sound(path).withColumn("__b", F.date_trunc(bucket, TIME)).groupBy(KEY, "__b").agg(F.max(top).alias("__e"))
    before = Window.partitionBy(KEY).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(KEY, "__b", F.max("__e").over(before).alias("__c"))
    w = Window.partitionBy(KEY, "__b").orderBy(TIME)
    again = F.coalesce(F.lag(TIME).over(w) == F.col(TIME), F.lit(False))
    held = sound(path).withColumn("__b", F.date_trunc(bucket, TIME)).join(carry, [KEY, "__b"])
    held = held.withColumn(VALUE, refuse_when(again, "NOT_A_SERIES", "times must differ within a series", F.col(VALUE)))
    held = held.select(KEY, TIME, VALUE, F.greatest(F.max(top).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__c").alias("p"))
    held = held.withColumn("d", 1 - F.col(VALUE) / F.nullif(F.col(f"p.{VALUE}"), F.lit(0.0)))
    best = held.groupBy(KEY).agg(F.min(VALUE).alias("low"), F.max_by(F.struct("d", "p", TIME), F.struct("d", -F.unix_micros(TIME))).alias("m"))
    depth = refuse_when(F.col("low") <= 0, "NOT_DEFINED", "a drawdown needs values above 0", F.col("m.d"))
    return best.select(KEY, depth.alias("depth"), F.timestamp_micros(-F.col("m.p.t")).alias("peak_time"), F.col(f"m.{TIME}").alias("trough_time"))


def ratios(rets: DataFrame, periods_per_year: float, target: float = 0.0) -> DataFrame:
    """(series_id, volatility, sharpe, sortino) a year; sortino's downside is a population one."""
    down = F.least(F.col(VALUE) - target, F.lit(0.0))
    held = sound(rets).groupBy(KEY).agg(F.count("*").alias("n"), F.avg(F.col(VALUE) - target).alias("m"), F.stddev_samp(VALUE).alias("s"), F.sqrt(F.avg(down * down)).alias("d"))
    root, z = float(periods_per_year) ** 0.5, F.lit(0.0)
    sharpe = refuse_when((F.col("n") < 2) | (F.col("s") == 0), "NOT_DEFINED", "sharpe needs returns that vary", F.col("m") / F.nullif(F.col("s"), z) * root)
    sortino = refuse_when(F.col("d") == 0, "NOT_DEFINED", "sortino needs a return below the target", F.col("m") / F.nullif(F.col("d"), z) * root)
    return held.select(KEY, (F.col("s") * root).alias("volatility"), sharpe.alias("sharpe"), sortino.alias("sortino"))


def _key(value: Column) -> Column:
    """A whole number of 64 bits that orders as the doubles do; both zeros have one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + 0.0).cast("bigint")
    return bound(bits, lambda b: F.when(b < 0, b.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(b))


def _value(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def ranked(s: DataFrame, ranks: DataFrame) -> DataFrame:
    """(series_id, rank, value): the values at ranks from 0 of each series; ``ranks``: (series_id, rank), as the series has.

    Values become sortable keys of 64 bits, whose digits, three of 22, 21 and 21 bits, are counted one after another: a count
    of each digit tells which of them holds a rank, and only values with that digit go on. Nothing is sorted but counts,
    however the values lie or repeat."""
    rows = s.select(KEY, _key(F.col(VALUE)).alias("k"))
    left = ranks.select(KEY, "rank", F.col("rank").alias("r"), F.lit(0).cast("bigint").alias("at"))
    rows, at = held(rows, "keys"), None
    for shift in SHIFTS:
        digit = F.shiftright("k", shift)
        wanted = left.select(KEY, "at").distinct()
        some = rows.join(wanted, KEY) if at is None else rows.join(wanted, [rows[KEY] == wanted[KEY], F.shiftright(rows["k"], at) == wanted["at"]]).drop(wanted[KEY])
        counts = some.groupBy(KEY, "at", digit.alias("digit")).agg(F.count("*").alias("c"))
        before = Window.partitionBy(KEY, "at").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        # a rank meets the digits of its own series and prefix, and stays with one
        met = left.join(counts, [KEY, "at"]).where("before <= r AND r < before + c")
        left, at = met.select(KEY, "rank", (F.col("r") - F.col("before")).alias("r"), F.col("digit").alias("at")), shift
        left = held(left, "ranks")  # a row for each rank; passes would repeat those before them
    return left.select(KEY, "rank", _value(F.col("at")).alias(VALUE))


def quantile(s: DataFrame, share: float) -> DataFrame:
    """(series_id, q): the interpolated quantile of each series."""
    n = s.groupBy(KEY).agg(F.count("*").alias("n")).withColumn("lo", F.floor((F.col("n") - 1) * share))
    n = held(n, "sizes")
    both = n.select(KEY, F.explode(F.array_distinct(F.array("lo", F.least(F.col("lo") + 1, F.col("n") - 1)))).alias("rank"))
    found = ranked(s, both).groupBy(KEY).agg(F.min_by(VALUE, "rank").alias("x"), F.max_by(VALUE, "rank").alias("y"))
    over = (F.col("n") - 1) * share - F.col("lo")
    return found.join(n, KEY).select(KEY, (F.col("x") + F.when(over > 0, over * (F.col("y") - F.col("x"))).otherwise(0.0)).alias("q"))


def tail(rets: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(series_id, value_at_risk, expected_shortfall): the interpolated quantile of losses and the mean beyond it."""
    if not 0 < confidence < 1:
        raise Refused("NOT_DEFINED", "confidence lies between 0 and 1", "confidence")
    rets = sound(rets)
    q = quantile(rets, 1 - confidence)
    return rets.join(q, KEY).groupBy(KEY).agg((-F.first("q")).alias("value_at_risk"), (-F.avg(F.when(F.col(VALUE) <= F.col("q"), F.col(VALUE)))).alias("expected_shortfall"))


def zscores(s: DataFrame) -> DataFrame:
    """Each value against its whole series; constant series are refused."""
    s = sound(s)
    m = s.groupBy(KEY).agg(F.avg(VALUE).alias("__m"), F.stddev_samp(VALUE).alias("__s"))
    z = refuse_when(F.col("__s") == 0, "NOT_DEFINED", "z-scores need values that vary", (F.col(VALUE) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    return s.join(m, KEY).select(KEY, TIME, z.alias(VALUE))


def covariances(*many: DataFrame) -> DataFrame:
    """(series_id, n, matrix): sample covariances on the instants that all share."""
    from .series import align

    v = [F.get("values", F.lit(i)) for i in range(len(many))]
    return align(*many).groupBy(KEY).agg(F.count("*").alias("n"), F.array(*(F.array(*(F.covar_samp(p, q) for q in v)) for p in v)).alias("matrix"))


def exposure(y: DataFrame, x: DataFrame) -> DataFrame:
    """(series_id, beta, alpha, r_squared, n) of y on x over shared instants, three at least; r squared of a constant y is 1."""
    held = _pair(y, x).groupBy(KEY).agg(F.count("*").alias("n"), F.var_samp("b").alias("vx"), F.var_samp("a").alias("vy"), F.covar_samp("a", "b").alias("c"), F.avg("a").alias("my"), F.avg("b").alias("mx"))
    zero = F.lit(0.0)
    beta = F.col("c") / F.nullif(F.col("vx"), zero)
    bad = (F.col("n") < 3) | (F.col("vx") == 0)
    r2 = F.when(F.col("vy") == 0, 1.0).otherwise(F.col("c") * F.col("c") / F.nullif(F.col("vx") * F.col("vy"), zero))
    return held.select(KEY, refuse_when(bad, "NOT_DEFINED", "exposure needs three shared instants and an x that varies", beta).alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"), r2.alias("r_squared"), "n")


def relative(path: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A path's returns against a benchmark's on shared instants (four at least): n, excess_return (mean difference),
    tracking_error, information_ratio, beta, correlation, up_capture, down_capture; ratios that are undefined are null."""
    both = _pair(path, benchmark)
    ret = lambda c: F.col(c) / F.nullif(F.lag(c).over(_by_time()), F.lit(0.0)) - 1
    r = both.select(KEY, TIME, ret("a").alias("p"), ret("b").alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    zero, up, down = F.lit(0.0), F.col("q") > 0, F.col("q") < 0
    held = r.groupBy(KEY).agg(
        F.count("*").alias("n"), F.avg(F.col("p") - F.col("q")).alias("e"), F.stddev_samp(F.col("p") - F.col("q")).alias("t"), F.covar_samp("p", "q").alias("c"), F.stddev_samp("p").alias("sp"), F.stddev_samp("q").alias("sq"),
        F.avg(F.when(up, F.col("p"))).alias("pu"), F.avg(F.when(up, F.col("q"))).alias("qu"), F.avg(F.when(down, F.col("p"))).alias("pd"), F.avg(F.when(down, F.col("q"))).alias("qd"),
    )
    return held.select(
        KEY, refuse_when(F.col("n") < 3, "NOT_DEFINED", "four shared instants are needed", F.col("n")).alias("n"), F.col("e").alias("excess_return"), F.col("t").alias("tracking_error"),
        (F.col("e") / F.nullif("t", zero)).alias("information_ratio"), (F.col("c") / F.nullif(F.col("sq") * F.col("sq"), zero)).alias("beta"), (F.col("c") / F.nullif(F.col("sp") * F.col("sq"), zero)).alias("correlation"),
        (F.col("pu") / F.nullif("qu", zero)).alias("up_capture"), (F.col("pd") / F.nullif("qd", zero)).alias("down_capture"),
    )


def excess(path: DataFrame, rate: DataFrame, rate_in: str = "percent", bucket: str = "month") -> DataFrame:
    """The path net of what a yearly rate earns, from the same start: each step multiplies by 1 + return - earned, where
    earned compounds the rate known at the step's start over its length. Prices must be above 0, and a path and its rate
    share two instants. Steps are multiplied within a ``bucket``; what the buckets before it come to, and their last instant,
    are carried over, so no window runs over a whole series but that of a row for each bucket."""
    choice(rate_in, ("percent", "fraction"), "rate_in")
    both = _pair(path, rate).withColumn("__last", F.struct(TIME, "a", "b"))
    both = carried(both, bucket, F.max("__last"), "__c")
    w = Window.partitionBy(KEY, "__b").orderBy(TIME)
    before = F.coalesce(F.lag("__last").over(w), F.col("__c"))
    steps = both.select(KEY, TIME, "__b", "a", before.alias("p"))
    years = (F.unix_micros(TIME) - F.unix_micros(F.col(f"p.{TIME}"))) / (1e6 * YEAR_S)
    yearly = F.col("p.b") / (100.0 if rate_in == "percent" else 1.0)
    factor = F.when(F.col("p").isNull(), 1.0).otherwise(F.col("a") / F.nullif(F.col("p.a"), F.lit(0.0)) - (F.pow(1 + yearly, years) - 1))
    run = steps.select(KEY, TIME, "__b", "a", F.product(factor).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    earlier = Window.partitionBy(KEY).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(KEY)
    ends = run.groupBy(KEY, "__b").agg(F.max_by("x", TIME).alias("e"), F.min_by("a", TIME).alias("f"), F.count("*").alias("n"), F.min("a").alias("low"))
    ends = ends.select(KEY, "__b", F.coalesce(F.product("e").over(earlier), F.lit(1.0)).alias("e"), F.min_by("f", "__b").over(all_).alias("f"), F.sum("n").over(all_).alias("n"), F.min("low").over(all_).alias("low"))
    value = F.col("f") * F.col("e") * F.col("x")
    value = refuse_when((F.col("n") < 2) | (F.col("low") <= 0), "NOT_DEFINED", "a path needs prices above 0 and two instants shared with its rate", value)
    return run.join(ends, [KEY, "__b"]).select(KEY, TIME, value.alias(VALUE))
