"""Queries over the test tables, each over its whole tables, with the SQL that says the same.

Sums of floats depend on the order of addition, so values are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import decisions as D
from ..functions import text as X
from ..functions import times as T
from ..functions.detect import detect
from ..functions.options import _BOTTOM, _FAR, _TOP, american, black_scholes, implied_vol, norm_cdf
from ..operators import claims, forecasts, judgment, mixed, paths, records, series, trials
from ..scratch import shared_dir
from ..sources import convert, ranges, sinks
from ..sources.repair import repair_csv, repair_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value by status, as series."""
    daily = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    return series.series(daily, "o_orderdate", "v", "o_orderstatus")


def ships_series(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "lineitem").groupBy("l_linestatus", "l_shipdate").agg(F.sum("l_extendedprice").alias("v"))
    return series.series(daily, "l_shipdate", "v", "l_linestatus")


def events_series(spark: SparkSession, d: str) -> DataFrame:
    return series.series(table(spark, d, "events"), "ts", "value", "event_type")


_S1 = "s1 AS (SELECT o_orderstatus AS k, o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)"
_S2 = "s2 AS (SELECT l_linestatus AS k, l_shipdate AS t, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"
_S3 = "s3 AS (SELECT event_type AS k, ts AS t, value AS v FROM events)"
_TS = "strftime(t, '%Y-%m-%d %H:%M:%S')"


def shown(s: DataFrame, digits: int = 2, *more: str) -> DataFrame:
    return s.select("series_id", *more, F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("value", digits).alias("value"))


def _resample_queries() -> None:
    sql = {"last": "arg_max(v, t)", "mean": "avg(v)", "sum": "sum(v)"}
    for every, unit in series.UNITS.items():
        for how, expr in sql.items():
            def run(spark, d, every=every, how=how):
                got = series.resample(orders_series(spark, d), every, how)
                # sums of cents over 8 or 16 days stand in the middle between two roundings: lifted on both sides
                return shown(got.withColumn("value", F.col("value") + 1e-7), 4) if how == "mean" else shown(got)

            query(f"WITH {_S1}, r AS (SELECT k, max(t) AS t, {expr} AS v FROM s1 GROUP BY k, date_trunc('{unit}', t)) SELECT k AS series_id, {_TS} AS time, round(v{' + 1e-7' if how == 'mean' else ''}, {4 if how == 'mean' else 2}) AS value FROM r", f"series_resample_{every}_{how}")(run)


def _step_queries() -> None:
    lagged = lambda n: f"lag(v, {n}) OVER (PARTITION BY k ORDER BY t)"
    for how, expr in {"percent": "CASE WHEN b <> 0 THEN (v / b - 1) * 100 END", "log": "CASE WHEN b > 0 AND v > 0 THEN ln(v / b) END", "difference": "v - b"}.items():
        for over in (1, 3):
            def run(spark, d, how=how, over=over):
                return shown(series.change(orders_series(spark, d), how, over), 4 if how != "difference" else 2)

            digits = 2 if how == "difference" else 4
            query(f"WITH {_S1}, r AS (SELECT k, t, v, {lagged(over)} AS b FROM s1), c AS (SELECT k, t, {expr} AS v FROM r WHERE b IS NOT NULL) SELECT k AS series_id, {_TS} AS time, round(v, {digits}) + 0.0 AS value FROM c WHERE v IS NOT NULL", f"series_change_{how}" + (f"_over{over}" if over > 1 else ""))(run)
    frame = "OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    for stat, expr in {"mean": "m", "sd": "s", "zscore": "(v - m) / s", "vol": "s * sqrt(365.0)"}.items():
        def run(spark, d, stat=stat):
            return shown(series.rolling(orders_series(spark, d), 7, stat, 365.0 if stat == "vol" else None), 3)

        query(f"WITH {_S1}, r AS (SELECT k, t, v, count(*) {frame} AS n, avg(v) {frame} AS m, stddev_samp(v) {frame} AS s FROM s1) SELECT k AS series_id, {_TS} AS time, round({expr}, 3) AS value FROM r WHERE n = 7 AND ('{stat}' <> 'zscore' OR s > 0)", f"series_rolling_{stat}")(run)
    for op, sign in {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}.items():
        def run(spark, d, op=op):
            return shown(series.combine(orders_series(spark, d), ships_series(spark, d), op), 4 if op == "divide" else 0 if op == "multiply" else 2)

        digits = 4 if op == "divide" else 0 if op == "multiply" else 2
        query(f"WITH {_S1}, {_S2} SELECT s1.k AS series_id, strftime(s1.t, '%Y-%m-%d %H:%M:%S') AS time, round(s1.v {sign} s2.v, {digits}) AS value FROM s1 JOIN s2 ON s1.t = s2.t AND s1.k = s2.k WHERE '{op}' <> 'divide' OR s2.v <> 0", f"series_combine_{op}")(run)
    for side, sign in {"above": ">", "below": "<", "at_least": ">=", "at_most": "<="}.items():
        for kept in (True, False):
            def run(spark, d, side=side, kept=kept):
                return shown(series.keep(events_series(spark, d), side, 50.0)[0 if kept else 1], 6)

            query(f"WITH {_S3} SELECT k AS series_id, {_TS} AS time, round(v, 6) AS value FROM s3 WHERE {'' if kept else 'NOT '}v {sign} 50.0", f"series_filter_{side}" + ("" if kept else "_dropped"))(run)
    for what, expr in {"last": "arg_max(v, t)", "first": "arg_min(v, t)", "mean": "avg(v)", "stdev": "stddev_samp(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)"}.items():
        def run(spark, d, what=what):
            return series.summarize(events_series(spark, d), what).select("series_id", F.round("value", 6).alias("value"))

        query(f"WITH {_S3} SELECT k AS series_id, round({expr}, 6) AS value FROM s3 GROUP BY k", f"series_summarize_{what}")(run)


_resample_queries()
_step_queries()


@query(f"WITH {_S1}, r AS (SELECT k, t, lag(v, 2) OVER (PARTITION BY k ORDER BY t) AS v FROM s1) SELECT k AS series_id, {_TS} AS time, round(v, 2) AS value FROM r WHERE v IS NOT NULL")
def series_lag(spark, d):
    return shown(series.lag(orders_series(spark, d), 2))


def _three(spark, d):
    s = orders_series(spark, d)
    return [s.where(F.col("series_id") == k).withColumn("series_id", F.lit("all")) for k in ("F", "O", "P")]


_ABC = f"WITH {_S1}, j AS (SELECT a.t, a.v AS a, b.v AS b, c.v AS c FROM s1 a JOIN s1 b ON a.t = b.t JOIN s1 c ON a.t = c.t WHERE a.k = 'F' AND b.k = 'O' AND c.k = 'P')"


@query(f"{_ABC} SELECT {_TS} AS time, round(a, 2) AS v1, round(b, 2) AS v2, round(c, 2) AS v3 FROM j")
def series_align_three(spark, d):
    v = lambda i: F.round(F.get("values", F.lit(i)), 2).alias(f"v{i + 1}")
    return series.align(*_three(spark, d)).select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), v(0), v(1), v(2))


@query(f"WITH {_S3} SELECT k AS series_id, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time, round(arg_min(v, t), 6) AS first, round(arg_max(v, t), 6) AS last, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM s3 GROUP BY k")
def series_describe(spark, d):
    f = lambda c: F.date_format(f"`{c}`", "yyyy-MM-dd HH:mm:ss")
    got = series.describe(events_series(spark, d))
    return got.select("series_id", F.col("count").alias("n"), f("from").alias("first_time"), f("to").alias("last_time"), *(F.round(c, 6).alias(c) for c in ("first", "last", "mean", "sd", "min", "max")))


@query(f"{_ABC} SELECT round(corr(a, b), 6) AS correlation, count(*) AS n FROM j")
def series_correlate(spark, d):
    a, b, c = _three(spark, d)
    shared = series.align(a, b, c).select("series_id", "time")
    return series.correlate(a.join(shared, ["series_id", "time"], "left_semi"), b.join(shared, ["series_id", "time"], "left_semi")).select(F.round("correlation", 6).alias("correlation"), "n")


_REGRESS = (
    f"{_ABC}, m AS (SELECT covar_samp(b, b) AS xx, covar_samp(b, c) AS xz, covar_samp(c, c) AS zz, covar_samp(a, b) AS xy, covar_samp(a, c) AS zy, covar_samp(a, a) AS yy, avg(a) AS my, avg(b) AS mx, avg(c) AS mz, count(*) AS n FROM j), "
    "s AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM m)"
)


@query(f"WITH {_S1}, {_S2} SELECT s1.k AS series_id, count(*) AS n, round(var_samp(s1.v) / 1e6, 2) AS aa, round(covar_samp(s1.v, s2.v) / 1e6, 2) AS ab, round(var_samp(s2.v) / 1e6, 2) AS bb FROM s1 JOIN s2 ON s1.k = s2.k AND s1.t = s2.t GROUP BY 1")
def series_covariances(spark, d):
    m = paths.covariances(orders_series(spark, d), ships_series(spark, d))
    at = lambda i, j, name: F.round(F.get(F.get("matrix", F.lit(i)), F.lit(j)) / 1e6, 2).alias(name)
    return m.select("series_id", "n", at(0, 0, "aa"), at(0, 1, "ab"), at(1, 1, "bb"))


@query(f"{_REGRESS} SELECT round(my - b1 * mx - b2 * mz, 2) AS alpha, round(b1, 6) AS beta1, round(b2, 6) AS beta2, round((b1 * xy + b2 * zy) / yy, 6) AS r_squared, round(sqrt((n - 1) * (yy - b1 * xy - b2 * zy) / (n - 3)), 2) AS residual_std, n AS observations FROM s")
def series_regress(spark, d):
    out, _ = series.regress(*_three(spark, d))
    b = lambda i: F.round(F.get("betas", F.lit(i)), 6).alias(f"beta{i + 1}")
    return out.select(F.round("alpha", 2).alias("alpha"), b(0), b(1), F.round("r_squared", 6).alias("r_squared"), F.round("residual_std", 2).alias("residual_std"), "observations")


@query(f"{_REGRESS} SELECT {_TS} AS time, round(a - (my - b1 * mx - b2 * mz) - b1 * b - b2 * c, 1) AS value FROM j, s")
def series_regress_residuals(spark, d):
    return shown(series.regress(*_three(spark, d))[1], 1).drop("series_id")


@query(f"WITH {_S2}, q AS (SELECT o_orderstatus AS k, o_orderdate + INTERVAL 12 HOUR AS t, o_orderkey AS id FROM orders) SELECT q.id, strftime(s2.t, '%Y-%m-%d %H:%M:%S') AS as_of_time, round(s2.v, 2) AS as_of_value FROM q ASOF LEFT JOIN s2 ON q.k = s2.k AND q.t >= s2.t")
def series_as_of(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("time"), F.col("o_orderkey").alias("id"))
    return series.as_of(left, ships_series(spark, d)).select("id", F.date_format("as_of_time", "yyyy-MM-dd HH:mm:ss").alias("as_of_time"), F.round("as_of_value", 2).alias("as_of_value"))


_RET = f"WITH {_S1}, r AS (SELECT * FROM (SELECT k, t, v / lag(v) OVER (PARTITION BY k ORDER BY t) - 1 AS r FROM s1) WHERE r IS NOT NULL)"


@query(f"WITH {_S1}, g AS (SELECT k, arg_min(v, t) AS f, arg_max(v, t) AS l, date_diff('day', min(t), max(t)) / 365.25 AS y FROM s1 GROUP BY k) SELECT k AS series_id, round(l / f - 1, 6) AS total_return, round(pow(l / f, 1 / y) - 1, 6) AS cagr FROM g")
def path_growth(spark, d):
    return paths.growth(orders_series(spark, d)).select("series_id", F.round("total_return", 6).alias("total_return"), F.round("cagr", 6).alias("cagr"))


@query(f"WITH {_S1}, p AS (SELECT k, t, v, max(v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS m FROM s1) SELECT k AS series_id, round(max(1 - v / m), 6) AS depth, strftime(arg_max(t, 1 - v / m), '%Y-%m-%d') AS trough FROM p GROUP BY k")
def path_drawdown(spark, d):
    return paths.drawdown(orders_series(spark, d)).select("series_id", F.round("depth", 6).alias("depth"), F.date_format("trough_time", "yyyy-MM-dd").alias("trough"))


@query(f"{_RET} SELECT k AS series_id, round(stddev_samp(r) * sqrt(365.0), 6) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(365.0), 6) AS sharpe, round(avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(365.0), 6) AS sortino FROM r GROUP BY k")
def path_ratios(spark, d):
    return paths.ratios(paths.returns(orders_series(spark, d)), 365.0).select("series_id", *(F.round(c, 6).alias(c) for c in ("volatility", "sharpe", "sortino")))


@query(f"{_RET}, q AS (SELECT k, quantile_cont(r, 0.05) AS q FROM r GROUP BY k) SELECT r.k AS series_id, round(-any_value(q), 6) AS value_at_risk, round(-avg(CASE WHEN r <= q THEN r END), 6) AS expected_shortfall FROM r JOIN q ON r.k = q.k GROUP BY r.k")
def path_tail(spark, d):
    return paths.tail(paths.returns(orders_series(spark, d))).select("series_id", F.round("value_at_risk", 6).alias("value_at_risk"), F.round("expected_shortfall", 6).alias("expected_shortfall"))


@query(f"{_ABC} SELECT round(regr_slope(a, b), 6) AS beta, round(regr_intercept(a, b), 2) AS alpha, round(regr_r2(a, b), 6) AS r_squared, count(*) AS n FROM j")
def path_exposure(spark, d):
    a, b, c = _three(spark, d)
    held = series.align(a, b, c)
    one = lambda i: held.select("series_id", "time", F.get("values", F.lit(i)).alias("value"))
    return paths.exposure(one(0), one(1)).select(F.round("beta", 6).alias("beta"), F.round("alpha", 2).alias("alpha"), F.round("r_squared", 6).alias("r_squared"), "n")


@query(
    f"{_ABC}, r AS (SELECT * FROM (SELECT a / lag(a) OVER (ORDER BY t) - 1 AS p, b / lag(b) OVER (ORDER BY t) - 1 AS q FROM j) WHERE p IS NOT NULL) SELECT count(*) AS n, round(avg(p - q), 5) AS excess_return, round(stddev_samp(p - q), 5) AS tracking_error, round(avg(p - q) / stddev_samp(p - q), 5) AS information_ratio, round(covar_samp(p, q) / var_samp(q), 5) AS beta, round(corr(p, q), 5) AS correlation, round(avg(p) FILTER (q > 0) / avg(q) FILTER (q > 0), 5) AS up_capture, round(avg(p) FILTER (q < 0) / avg(q) FILTER (q < 0), 5) AS down_capture FROM r"
)
def path_relative(spark, d):
    a, b, c = _three(spark, d)
    held = series.align(a, b, c)
    one = lambda i: held.select("series_id", "time", F.get("values", F.lit(i)).alias("value"))
    got = paths.relative(one(0), one(1))
    return got.select("n", *(F.round(c, 5).alias(c) for c in got.columns if c not in ("series_id", "n")))


@query(f"WITH {_S1} SELECT k AS series_id, {_TS} AS time, round((v - avg(v) OVER (PARTITION BY k)) / stddev_samp(v) OVER (PARTITION BY k), 6) AS value FROM s1")
def path_zscores(spark, d):
    return shown(paths.zscores(orders_series(spark, d)), 6)


@query(
    f"WITH {_S1}, f AS (SELECT k, t, first_value(v) OVER w AS f, v / lag(v) OVER w - (pow(1 + (day(lag(t) OVER w) % 9 - 2) / 100.0, date_diff('day', lag(t) OVER w, t) / 365.25) - 1) AS x FROM s1 WINDOW w AS (PARTITION BY k ORDER BY t)), p AS (SELECT k, t, f * product(coalesce(x, 1)) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM f) SELECT k AS series_id, {_TS} AS time, sign(v)::INTEGER AS side, round(ln(abs(v)), 6) AS value FROM p"
)
def path_excess(spark, d):
    """Net of a rate that changes from day to day; in logarithms, as the product runs over many powers of ten."""
    s = orders_series(spark, d)
    net = paths.excess(s, s.withColumn("value", (F.dayofmonth("time") % 9 - 2).cast("double")))
    return shown(net.withColumn("side", F.signum("value").cast("int")).withColumn("value", F.log(F.abs("value"))), 6, "side")


_LONG = "s AS (SELECT make_timestamp(CAST(1893456000000000 + event_id * 1000000 AS BIGINT)) AS t, value AS v FROM events)"


def _long_series(spark, d):
    """All events as one series, a second apart."""
    at = F.timestamp_micros(1893456000000000 + F.col("event_id") * 1000000)
    return series.series(table(spark, d, "events"), at, "value")


@query(f"WITH {_LONG}, w AS (SELECT t, avg(v) OVER w AS m, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY t ROWS 199 PRECEDING)) SELECT 'all' AS series_id, {_TS} AS time, round(m, 7) AS value FROM w WHERE n = 200")
def series_rolling_long(spark, d):
    """One long series, its windows spread over many tasks."""
    return shown(series.rolling(_long_series(spark, d), 200, long=True), 7)


@query(f"WITH {_LONG}, w AS (SELECT t, (v / lag(v, 30) OVER (ORDER BY t) - 1) * 100 AS c FROM s) SELECT 'all' AS series_id, {_TS} AS time, round(c, 6) AS value FROM w WHERE c IS NOT NULL")
def series_change_long(spark, d):
    return shown(series.change(_long_series(spark, d), over=30, long=True), 6)


_CLAIMS = "SELECT l_orderkey, l_linenumber, l_partkey AS subject, l_linenumber % 2 = 0 AS up, l_suppkey % 2 = 0 AS strict, CAST(l_quantity AS BIGINT) AS level, CAST((l_orderkey * 37 + l_linenumber * 991) % 10001 AS INTEGER) AS bps FROM lineitem"
_IMPLIES = "x.up = y.up AND CASE WHEN x.level = y.level THEN x.strict OR NOT y.strict WHEN x.up THEN y.level < x.level ELSE x.level < y.level END"
_ABOVE, _BELOW, _EITHER = ("CASE WHEN x.up THEN x.level ELSE y.level END", "CASE WHEN x.up THEN y.level ELSE x.level END", "x.up <> y.up")


@query(
    f"WITH c AS ({_CLAIMS}), n AS (SELECT row_number() OVER () AS r, * FROM c), f AS (SELECT x.r, bool_or({_IMPLIES} AND y.bps < x.bps) AS too_likely, bool_or({_IMPLIES.replace('x.', 'z.').replace('y.', 'x.').replace('z.', 'y.')} AND x.bps < y.bps) AS too_unlikely, bool_or({_EITHER} AND ({_BELOW} < {_ABOVE} OR x.level = y.level AND (x.strict OR y.strict)) AND x.bps + y.bps > 10000) AS too_much, bool_or({_EITHER} AND ({_ABOVE} < {_BELOW} OR x.level = y.level AND NOT (x.strict AND y.strict)) AND x.bps + y.bps < 10000) AS too_little FROM n x JOIN n y USING (subject) GROUP BY x.r) SELECT l_orderkey, l_linenumber, subject, up, level, bps, too_likely, too_unlikely, too_much, too_little FROM n JOIN f USING (r)"
)
def claims_that_clash(spark, d):
    """Line items read as claims on their parts."""
    said = table(spark, d, "lineitem").selectExpr(*_CLAIMS.removeprefix("SELECT ").removesuffix(" FROM lineitem").split(", "))
    return claims.clashes(said).select("l_orderkey", "l_linenumber", "subject", "up", "level", "bps", "too_likely", "too_unlikely", "too_much", "too_little")


# record programs
PROGRAM = [
    {"op": "filter", "field": "c_mktsegment", "predicate": "ne", "value": "BUILDING"},
    {"op": "filter", "field": "c_acctbal", "predicate": "gt", "value": 0.0},
    {"op": "map_field", "field": "c_mktsegment", "transform": "lowercase"},
    {"op": "rename_field", "from": "c_mktsegment", "to": "segment"},
    {"op": "set_field", "field": "checked", "value": True},
    {"op": "drop_fields", "fields": ["c_nationkey", "nothing"]},
    {"op": "sort_by", "field": "segment", "order": "asc"},
    {"op": "reverse"},
    {"op": "limit", "n": 100},
]


@query("SELECT c_custkey, c_name, c_acctbal, segment, checked FROM (SELECT c_custkey, c_name, c_acctbal, lower(c_mktsegment) AS segment, true AS checked FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0) ORDER BY segment DESC, c_custkey DESC LIMIT 100")
def records_program(spark, d):
    return records.rows(records.numbered(table(spark, d, "customer"), "c_custkey"), PROGRAM)


def _record_query(name: str, tab: str, key: str, steps: list[dict], sql: str, more: dict | None = None) -> None:
    def run(spark, d):
        return records.rows(records.numbered(table(spark, d, tab).withColumns({c: F.expr(x) for c, x in (more or {}).items()}), key), steps)

    query(sql, f"records_{name}")(run)


def _filter(field: str, predicate: str, value=None) -> dict:
    return {"op": "filter", "field": field, "predicate": predicate} | ({} if value is None else {"value": value})


def _map(field: str, transform: str) -> dict:
    return {"op": "map_field", "field": field, "transform": transform}


_record_query("select", "supplier", "s_suppkey", [{"op": "select_fields", "fields": ["s_name", "s_acctbal", "nothing"]}], "SELECT s_name, s_acctbal FROM supplier")
_record_query("contains", "part", "p_partkey", [_filter("p_type", "contains", "M")], "SELECT * FROM part WHERE strpos(p_type, 'M') > 0")
_record_query("range", "part", "p_partkey", [_filter("p_size", "ge", 10), _filter("p_name", "lt", "m")], "SELECT * FROM part WHERE p_size >= 10 AND p_name < 'm'")
_seen = {"seen": "CASE WHEN quality = 1 THEN toxic END"}
_record_query("exists", "labels", "doc_id", [_filter("seen", "exists"), _filter("missing", "not_exists")], "SELECT *, toxic AS seen FROM labels WHERE quality = 1", _seen)
_record_query("not_exists", "labels", "doc_id", [_filter("seen", "not_exists")], "SELECT *, CAST(NULL AS INTEGER) AS seen FROM labels WHERE quality <> 1", _seen)
_record_query("to_string", "supplier", "s_suppkey", [_map("s_nationkey", "to_string"), _map("s_name", "uppercase")], "SELECT s_suppkey, upper(s_name) AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_acctbal FROM supplier")
_record_query("to_number", "customer", "c_custkey", [_map("c_acctbal", "to_string"), _map("c_acctbal", "to_number"), _map("c_name", "trim")], "SELECT * FROM customer")
_record_query("top", "orders", "o_orderkey", [{"op": "sort_by", "field": "o_totalprice", "order": "desc"}, {"op": "limit", "n": 25}], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag DESC, l_orderkey DESC, l_linenumber DESC) - 1 AS place FROM lineitem")
def records_order(spark, d):
    """Places after a sort and a reversal, over the whole table."""
    steps = [{"op": "select_fields", "fields": ["l_orderkey", "l_linenumber", "l_returnflag"]}, {"op": "sort_by", "field": "l_returnflag", "order": "asc"}, {"op": "reverse"}]
    return records.run(records.numbered(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"), steps).select("l_orderkey", "l_linenumber", F.col("pos.n").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0")
def sequence_every_nth(spark, d):
    return records.every_nth(records.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 7).drop("pos")


#: values of all types by event: the JSON text, its class, number and text; absent where null
_MIXED = [("CAST(NULL AS {s})", "-1", "0.0", "''"), ("'null'", "0", "0.0", "''"), ("CASE WHEN value > 50 THEN 'true' ELSE 'false' END", "1", "CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END", "''"), ("CAST(user_id AS {s})", "2", "user_id", "''"), ("CAST(user_id AS {s}) || '.5'", "2", "user_id + 0.5", "''"), ("'\"' || event_type || '\"'", "3", "0.0", "event_type"), ("'[' || CAST(user_id AS {s}) || ',\"' || event_type || '\"]'", "4", "0.0", "'[' || CAST(user_id AS {s}) || ',\"' || event_type || '\"]'"), ("'{{\"k\":' || CAST(user_id AS {s}) || '}}'", "5", "0.0", "'{{\"k\":' || CAST(user_id AS {s}) || '}}'")]


def _mixed(column: int, text: str) -> str:
    return f"CASE CAST(event_id % {len(_MIXED)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {x[column].format(s=text)}" for i, x in enumerate(_MIXED)) + " END"


@query(f"WITH m AS (SELECT event_id, {_mixed(0, 'VARCHAR')} AS v, {_mixed(1, 'VARCHAR')} AS c, CAST({_mixed(2, 'VARCHAR')} AS DOUBLE) AS n, {_mixed(3, 'VARCHAR')} AS t FROM events) SELECT event_id, v, row_number() OVER (ORDER BY c DESC, n DESC, t DESC, event_id) - 1 AS place FROM m")
def records_mixed_order(spark, d):
    """Places after a sort by a field that holds values of every type, nulls and gaps."""
    v = F.expr(_mixed(0, "STRING"))
    rec = F.map_filter(F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("v"), v), lambda _, x: x.isNotNull())
    out = mixed.run(table(spark, d, "events").select("event_id", rec.alias("rec")), [{"op": "sort_by", "field": "v", "order": "desc"}], "event_id")
    return out.select(F.col("rec")["id"].cast("bigint").alias("event_id"), F.try_element_at("rec", F.lit("v")).alias("v"), F.col("pos.n").alias("place"))


@query(f"WITH m AS (SELECT event_id, {_mixed(0, 'VARCHAR')} AS v FROM events) SELECT event_id, v IS NOT NULL AS there, CASE WHEN v IS NULL THEN NULL WHEN v LIKE '\"%' THEN v ELSE '\"' || replace(v, '\"', '\\\"') || '\"' END AS s FROM m WHERE v IS NULL OR v <> 'true'")
def records_mixed_program(spark, d):
    """A test that absent values pass only as absent, then every value as text."""
    v = F.expr(_mixed(0, "STRING"))
    rec = F.map_filter(F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("v"), v), lambda _, x: x.isNotNull())
    e = table(spark, d, "events").select("event_id", rec.alias("rec"))
    ne = mixed.rows(e, [_filter("v", "ne", True), {"op": "set_field", "field": "there", "value": True}, _map("v", "to_string")], "event_id")
    none = mixed.rows(e, [_filter("v", "not_exists"), {"op": "set_field", "field": "there", "value": False}], "event_id")
    get = lambda k: F.try_element_at("rec", F.lit(k))
    return ne.union(none).select(get("id").cast("bigint").alias("event_id"), get("there").cast("boolean").alias("there"), get("v").alias("s"))


# scalars
@query("SELECT c_custkey, '\"' || CAST(c_custkey AS VARCHAR) || '\"' AS key_text, CAST(CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal - 0.5) ELSE floor(c_acctbal + 0.5) END AS BIGINT) AS balance, c_acctbal > 0 AS positive, CAST(c_acctbal > 0 AS BIGINT) AS as_number, CASE WHEN c_nationkey = 1 THEN true WHEN c_nationkey = 0 THEN false END AS nation_flag FROM customer")
def coerce_numbers(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", C.to_text(F.col("c_custkey")).alias("key_text"), C.number_to_integer(b).alias("balance"), (b > 0).alias("positive"), C.boolean_to_integer(b > 0).alias("as_number"), C.number_to_boolean(F.col("c_nationkey")).alias("nation_flag"))


_WORD = "CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN CAST(toxic AS {text}) WHEN 1 THEN upper(CAST(toxic = 1 AS {text})) WHEN 2 THEN CASE WHEN toxic = 1 THEN ' yes ' ELSE 'no' END WHEN 3 THEN CASE WHEN quality = 1 THEN 'On' ELSE 'oFF' END ELSE CAST(doc_id + 2 AS {text}) END"


@query(f"SELECT doc_id, {_WORD.format(text='VARCHAR')} AS word, CASE doc_id % 5 WHEN 4 THEN NULL WHEN 3 THEN quality = 1 ELSE toxic = 1 END AS flag FROM labels")
def coerce_boolean(spark, d):
    """Labels as words of several kinds, read back as booleans."""
    return table(spark, d, "labels").select("doc_id", F.expr(_WORD.format(text="STRING")).alias("word")).withColumn("flag", C.text_to_boolean(F.col("word")))


_KEY = "CAST(o_orderkey AS {text})"
_SHAPES = [(_KEY, "{f}"), (f"'0' || {_KEY}", "q"), (f"{_KEY} || '.5'", "{f}"), (f"{_KEY} || '.50'", "q"), (f"'+' || {_KEY}", "q"), ("o_orderstatus", "q"), ("''", "null"), ("CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END", "{f}"), (f"'-' || {_KEY}", "{f}"), (f"{_KEY} || ' '", "q"), (f"{_KEY} || '2345678.5'", "{f}"), (f"'0.000' || {_KEY} || '5'", "{f}"), (f"{_KEY} || '0000000.0'", "{f}"), (f"'0.0000000' || {_KEY}", "q"), (f"{_KEY} || 'e5'", "q")]


def _case(parts: list[str], text: str) -> str:
    return f"CASE CAST(o_custkey % {len(parts)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(parts)).replace("{text}", text) + " END"


@query(f"WITH w AS (SELECT o_orderkey, o_custkey, {_case([x for x, _ in _SHAPES], 'VARCHAR')} AS field FROM orders) SELECT o_orderkey, field, {_case([{'{f}': 'field', 'q': chr(39) + chr(34) + chr(39) + ' || field || ' + chr(39) + chr(34) + chr(39), 'null': chr(39) + 'null' + chr(39)}[k] for _, k in _SHAPES], 'VARCHAR')} AS json FROM w")
def csv_infer(spark, d):
    """Keys written in ways that keep or lose something as numbers."""
    field = F.expr(_case([x for x, _ in _SHAPES], "STRING"))
    return table(spark, d, "orders").select("o_orderkey", field.alias("field")).withColumn("json", C.infer_csv(F.col("field")))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS whole, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS half, CAST(p_size * 1000 AS VARCHAR) AS power, CAST(NULL AS VARCHAR) AS none, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS flag FROM part")
def coerce_text_to_number(spark, d):
    size = F.col("p_size").cast("string")
    half = F.concat(F.lit(" +"), (F.col("p_size") / 2).cast("string"))
    return table(spark, d, "part").select("p_partkey", C.text_to_number(size).alias("whole"), C.text_to_number(half).alias("half"), C.text_to_number(F.concat(size, F.lit("e3"))).alias("power"), C.text_to_number(F.col("p_name")).alias("none"), C.boolean_to_integer(F.col("p_size") > 25).cast("int").alias("flag"))


@query("SELECT n_nationkey, '{\"source_type\":\"string\",\"value\":\"' || n_name || '\"}' AS name, '{\"source_type\":\"integer\",\"value\":' || n_regionkey || '}' AS region, '\"[\\\"' || n_name || '\\\"]\"' AS nested FROM nation")
def coerce_to_object(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.to_object(F.col("n_name"), "string").alias("name"), C.to_object(F.col("n_regionkey"), "integer").alias("region"), C.nested_to_text(F.array("n_name")).alias("nested"))


@query("SELECT o_orderkey, o_orderdate <= DATE '1995-06-17' AND (o_orderstatus = 'O' OR DATE '1995-06-17' < o_orderdate + INTERVAL 90 DAY) AS valid, o_orderdate < DATE '1996-01-01' AND (o_orderstatus = 'O' OR DATE '1995-01-01' < o_orderdate + INTERVAL 90 DAY) AS overlaps FROM orders")
def time_validity(spark, d):
    """Orders that are valid for 90 days, or without an end while they are open."""
    t = lambda x: F.lit(x).cast("timestamp")
    start = F.col("o_orderdate").cast("timestamp")
    end = F.when(F.col("o_orderstatus") != "O", start + F.expr("INTERVAL 90 DAYS"))
    return table(spark, d, "orders").select("o_orderkey", T.valid_at(start, end, t("1995-06-17")).alias("valid"), T.overlaps(start, end, t("1995-01-01"), t("1996-01-01")).alias("overlaps"))


@query(
    "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'CY' WHEN 1 THEN 'MONTH' WHEN 2 THEN 'DAY' WHEN 3 THEN 'FY' END AS kind, CASE o_custkey % 5 WHEN 0 THEN strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS starts,"
    " CASE o_custkey % 5 WHEN 0 THEN strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS ends FROM orders"
)
def time_periods(spark, d):
    t = F.col("o_orderdate")
    year = F.date_format(t, "yyyy")
    label = F.get(F.array(F.concat(F.lit("CY"), year, F.lit("Q"), F.quarter(t).cast("string")), F.date_format(t, "yyyy-MM"), F.date_format(t, "yyyy-MM-dd"), F.concat(F.lit("FY"), year), F.concat(year, F.lit("-13"))), (F.col("o_custkey") % 5).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.period(label).alias("p")).select("o_orderkey", F.col("p.kind").alias("kind"), F.date_format("p.start", "yyyy-MM-dd").alias("starts"), F.date_format("p.end", "yyyy-MM-dd").alias("ends"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS instant, strftime(ts, '%Y%m%d') AS compact, CAST(isoyear(ts) AS INTEGER) AS iso_year, CAST(weekofyear(ts) AS INTEGER) AS iso_week, CAST(quarter(ts) AS INTEGER) AS quarter, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start FROM events")
def time_keys(spark, d):
    t = F.col("ts").cast("timestamp")
    key = T.calendar_key(t, "weekly")
    instant = T.parse_instant(T.format_instant(t))
    return table(spark, d, "events").select("event_id", F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss").alias("instant"), T.compact_day(t).alias("compact"), key["year"].alias("iso_year"), key["part"].alias("iso_week"), T.calendar_key(t, "quarterly")["part"].alias("quarter"), F.date_format(D.week_start(t), "yyyy-MM-dd").alias("week_start"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')) AS collapsed FROM documents")
def text_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, doc_id % 2 = 0 AND trim(text) <> '' AS is_grounded FROM documents")
def text_grounded(spark, d):
    """Whole texts as quotes of themselves, every second with a word more than there is."""
    quote = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\n(not there)")))
    return table(spark, d, "documents").select("doc_id", X.grounded(F.array(quote), F.col("text")).alias("is_grounded"))


#: extension, text made of an event's props, kind
_FILES = [
    ("json", "props", "json;record"), ("json", "'[' || props || ', ' || props || ']'", "json;list;record"), ("json", "'[1, 2]'", "json;list"), ("jsonl", "props || chr(10) || props", "ndjson;list;record"), ("ndjson", "'1' || chr(10) || '2'", "ndjson;list"),
    ("CSV", "'k' || chr(10) || '1'", "csv;list;record"), ("tsv", "props", "tsv;list;record"), ("psv", "props", "psv;list;record"), ("yaml", "'props: ' || event_type", "yaml;record"), ("yml", "'- ' || event_type", "yaml;list"), ("yaml", "'- kind: ' || event_type", "yaml;list;record"),
    ("yaml", "'---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || 'a: 2'", "yaml;list;record"), ("xml", "'<?xml version=\"1.0\"?><e k=\"1\"/>'", "xml;record"), ("xml", "'<es><e/><e/><e/></es>'", "xml;list;record"), ("toml", "'k = 1'", "toml"), ("bin", "props", None),
]


def _by_file(parts: list[str]) -> str:
    return f"CASE CAST(event_id % {len(_FILES)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(parts)) + " END"


@query(f"SELECT event_id, {_by_file([repr(k) if k else 'NULL' for *_, k in _FILES])} AS kind FROM events")
def detect_files(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get(detect(F.expr(_by_file([x for _, x, _ in _FILES])), F.expr(_by_file([f"'{x}'" for x, *_ in _FILES]))), F.lit(0)).alias("kind"))


# forecasts
_OUT = "o AS (SELECT quality AS g, CAST(round((doc_id % 101) / 100.0 * 10000) AS BIGINT) AS p, toxic = 1 AS c FROM labels), b AS (SELECT *, (CASE WHEN c THEN 10000 - p ELSE p END) * (CASE WHEN c THEN 10000 - p ELSE p END) // 10000 AS s FROM o)"


def _outcomes(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("group"), ((F.col("doc_id") % 101) / 100.0).alias("probability"), (F.col("toxic") == 1).alias("came_true"))


@query(f"WITH {_OUT} SELECT g AS \"group\", count(*) AS n, (sum(s) // count(*)) / 10000.0 AS brier, CAST(0.25 AS DOUBLE) AS even_brier, sum(s) // count(*) < 2500 AS beats_even FROM b GROUP BY g")
def forecast_score(spark, d):
    return forecasts.score(_outcomes(spark, d), "group")


@query(f"WITH {_OUT} SELECT least(p // 1000, 9) AS tenth, count(*) AS forecasts, round(sum(p) / count(*)) / 10000 AS said, count(*) FILTER (c) AS came_true FROM o GROUP BY 1")
def forecast_calibration(spark, d):
    return forecasts.calibration(_outcomes(spark, d))


_MOMENTS = f"{_OUT}, m AS (SELECT g, count(*) AS n, count(*) FILTER (c) AS came, sum(p)::HUGEINT AS said, sum(p * (10000 - p))::HUGEINT AS spread, sum(s)::HUGEINT AS s, sum(s * s)::HUGEINT AS q FROM b GROUP BY g)"


@query(
    f"WITH {_OUT}, k AS (SELECT g, p, count(*)::HUGEINT AS m, (count(*) FILTER (c))::HUGEINT AS c FROM o GROUP BY g, p), w AS (SELECT *, sum(m) OVER (PARTITION BY g)::HUGEINT AS n, sum(c) OVER (PARTITION BY g)::HUGEINT AS o FROM k), "
    "t AS (SELECT g, n, o, sum(c * (10000 - p) * (10000 - p) + (m - c) * p * p)::HUGEINT // n // 10000 AS total, sum((m * p - 10000 * c) * (m * p - 10000 * c) // m)::HUGEINT // n // 10000 AS off_by, sum(10000 * (n * c - m * o) * (n * c - m * o) // m)::HUGEINT // (n * n * n) AS told_apart, 10000 * o * (n - o) // (n * n) AS how_hard FROM w GROUP BY g, n, o) "
    'SELECT g AS "group", CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(off_by AS BIGINT) AS off_by, CAST(told_apart AS BIGINT) AS told_apart, CAST(how_hard AS BIGINT) AS how_hard, off_by <= 100 AS calibrated, how_hard > 0 AND how_hard <= 4 * told_apart AS discerning FROM t'
)
def forecast_split(spark, d):
    return forecasts.split(_outcomes(spark, d), "group")


@query(f"WITH {_MOMENTS} SELECT g AS \"group\", n, CASE WHEN n < 5 THEN 'untold' WHEN 4 * spread >= (said - 10000 * came) * (said - 10000 * came) THEN 'about' WHEN said > 10000 * came THEN 'too_high' ELSE 'too_low' END AS sureness FROM m")
def forecast_sureness(spark, d):
    m = forecasts.moments(_outcomes(spark, d), "group")
    return m.select("group", "n", forecasts.sureness(*map(F.col, ["n", "came", "said", "spread"])).alias("sureness"))


@query(f"WITH {_MOMENTS}, r AS (SELECT g, n, s, q, sum(n) OVER ()::HUGEINT - n AS rn, sum(s) OVER ()::HUGEINT - s AS rs, sum(q) OVER ()::HUGEINT - q AS rq FROM m), v AS (SELECT *, s / n::DOUBLE - rs / rn::DOUBLE AS d, (n * q - s * s)::DOUBLE / (n::DOUBLE * n * (n - 1)) AS e, (rn * rq - rs * rs)::DOUBLE / (rn::DOUBLE * rn * (rn - 1)) AS f FROM r) SELECT g AS \"group\", n, n >= 5 AND rn >= 5 AND coalesce(d * d > 4 * (e + f), false) AS apart FROM v")
def forecast_apart(spark, d):
    """Each group's score against that of all other forecasts; the window sees a row for each group."""
    m = forecasts.moments(_outcomes(spark, d), "group")
    rest = {f"rest_{c}": F.sum(c).over(Window.partitionBy(F.lit(0))) - F.col(c) for c in ("n", "s", "q")}
    return m.withColumns(rest).select("group", "n", forecasts.apart(*map(F.col, ["n", "s", "q", "rest_n", "rest_s", "rest_q"])).alias("apart"))


@query("WITH p AS (SELECT doc_id, (doc_id * 37) % 10001 AS p, doc_id % 7 AS came, doc_id % 7 + quality AS scored FROM labels) SELECT doc_id, least(greatest((least(came, scored) * 10000 + 5 * p) // (scored + 5), 100), 9900) AS reading, (2500 - least(p, 2500)) * 10000 // 2500 AS skill, CASE WHEN scored > 0 THEN least(came, scored) * 10000 // scored END AS base_rate FROM p")
def forecast_readings(spark, d):
    said, came = (F.col("doc_id") * 37) % 10001, F.col("doc_id") % 7
    scored = came + F.col("quality")
    return table(spark, d, "labels").select("doc_id", D.as_forecast(D.recalibrated(said, came, scored)).alias("reading"), D.skill(said).alias("skill"), D.base_rate(came, scored).alias("base_rate"))


@query("WITH e AS (SELECT user_id, event_type, count(*) AS n, bool_or(value > 50) AS hit, arg_max(value > 50, ts) AS latest FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN n % 3 = 0 THEN 'open' WHEN latest THEN 'came_true' ELSE 'did_not' END AS at_deadline, CASE WHEN hit THEN 'came_true' WHEN n % 3 = 0 THEN 'open' ELSE 'did_not' END AS any_time FROM e")
def forecast_settle(spark, d):
    """Whether a value above 50 was seen, by user and kind of event; every third group is not due yet."""
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ts", (F.col("value") > 50).alias("x")))), lambda x: x["x"]).alias("x"))
    due = F.col("n") % 3 != 0
    return seen.select("user_id", "event_type", D.settle("at_deadline", due, F.col("x")).alias("at_deadline"), D.settle("any_time", due, F.col("x")).alias("any_time"))


ASKED = trials.Asked("above", 1.0, 14, 21, stretches=3)


@query(
    f"WITH {_S1}, g AS (SELECT k, min(t) AS a, max(t) AS z FROM s1 GROUP BY k), m AS (SELECT k, unnest(generate_series(a + INTERVAL 21 DAY, z - INTERVAL 14 DAY, INTERVAL 21 DAY)) AS said FROM g), f AS (SELECT m.k, m.said, s1.v AS start FROM m ASOF JOIN s1 ON m.k = s1.k AND m.said >= s1.t),"
    " e AS (SELECT f.k, f.said, f.start, arg_max(s1.v, s1.t) AS ended FROM f JOIN s1 ON s1.k = f.k AND s1.t > f.said AND s1.t <= f.said + INTERVAL 14 DAY GROUP BY ALL) SELECT k AS series_id, strftime(said, '%Y-%m-%d') AS time, (ended / start - 1) * 100 > 1.0 AS came_true FROM e"
)
def trial_outcomes(spark, d):
    """How each statement came out; every moment of these series has some way that can say something."""
    m = trials.moments(orders_series(spark, d), ASKED).where("way = 0")
    return m.select("series_id", F.date_format("time", "yyyy-MM-dd").alias("time"), "came_true")


@query()
def trial_report(spark, d):
    return trials.trial(orders_series(spark, d), ASKED)[0]


@query()
def trial_stretches(spark, d):
    return trials.trial(orders_series(spark, d), ASKED)[1]


@query(
    "SELECT o_orderkey, CASE WHEN quarter(o_orderdate) > 1 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END * 10 + CASE WHEN quarter(o_orderdate) > 1 THEN quarter(o_orderdate) - 1 ELSE 4 END AS before, CASE WHEN month(o_orderdate) < 12 THEN year(o_orderdate) * 100 + month(o_orderdate) + 1 ELSE (year(o_orderdate) + 1) * 100 + 1 END AS after,"
    " CAST(strftime(o_orderdate - INTERVAL 17 MONTH, '%Y%m') AS BIGINT) AS back, strftime(date_trunc('week', o_orderdate) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_start, date_diff('day', DATE '1970-01-01', o_orderdate) * 86400000000 AS micros FROM orders"
)
def time_arithmetic(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    n = lambda p, base: (p["year"] * base + p["index"])
    y, q, m = F.year(t), F.quarter(t), F.month(t)
    epoch = F.timestamp_micros(F.lit(0))
    return table(spark, d, "orders").select(
        "o_orderkey", n(T.previous_period(y, q, 4), 10).alias("before"), n(T.next_period(y, m, 12), 100).alias("after"), n(T.back(y, m, 12, 17), 100).cast("bigint").alias("back"), F.date_format(T.last_week(t)["start"], "yyyy-MM-dd").alias("week_start"), T.since(T.plus(t, 0), epoch).alias("micros"),
    )


# judgments: a provider that reads the answer off the request
def _words_of(requests):
    import json

    out = []
    for prompt, _ in requests:
        text = prompt.split("\n\n", 1)[1]
        label = "short" if len(text) < 400 else "long" if len(text) < 1200 else "endless"
        out.append(json.dumps({"label": label, "confidence": 0.9, "reason": "its length"}))
    return out


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 400 THEN 'short' WHEN length(text) < 1200 THEN 'long' END AS label, length(coalesce(text, '')) >= 1200 AS refused FROM documents")
def judge_classify(spark, d):
    """Labels by a stub; those that were not allowed are refused."""
    got = judgment.judge(table(spark, d, "documents").select("doc_id", "text"), "classify", "text", F.lit("How long is it?"), _words_of, allowed=["short", "long"])
    return got.select("doc_id", F.col("reply.label").alias("label"), F.col("error").isNotNull().alias("refused"))


def _yes_no(requests):
    import json

    out = []
    for prompt, _ in requests:
        text = prompt.split("\n\n", 1)[1]
        res = [{"res": int("e" in text), "confidence": 0.9, "reason": "e"}, {"res": int(len(text) > 800), "confidence": 0.5, "reason": "n"}]
        out.append(json.dumps({"res": res[: 1 + (len(text) % 2)]}))  # every second reply lacks an answer
    return out


@query(
    "WITH q AS (SELECT doc_id, coalesce(text, '') AS t, unnest(['Has it an e?', 'Is it long?']) AS title FROM documents) SELECT doc_id, title, CASE WHEN length(t) % 2 = 1 THEN CASE title WHEN 'Has it an e?' THEN strpos(t, 'e') > 0 ELSE length(t) > 800 END END AS value, CASE WHEN length(t) % 2 = 1 THEN title = 'Is it long?' END AS unsure, length(t) % 2 = 0 AS refused FROM q"
)
def judge_decide_many(spark, d):
    got = judgment.decide_many(table(spark, d, "documents").select("doc_id", "text"), "text", ["Has it an e?", "Is it long?"], F.lit("Answer each:"), _yes_no)
    return got.select("doc_id", "title", "value", F.col("confidence_below_threshold").alias("unsure"), F.col("error").isNotNull().alias("refused"))


# options
def _option_rows(spark, d):
    r = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("right"), r.alias("spot"), (r * (0.8 + (F.col("p_partkey") % 5) / 10)).alias("strike"), F.lit(0.05).alias("rate"), F.lit(0.01).alias("dividend"), (0.1 + F.col("p_size") / 100.0).alias("vol"), F.lit(1.5).alias("time"))


_ARGS = ("right", "spot", "strike", "rate", "dividend", "vol", "time")


def _poly_sql(c: tuple, x: str) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


def _cdf_sql(x: str) -> str:
    """The distribution at x by the same published approximation, written out."""
    a = f"abs({x})"
    far = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65)))))"
    low = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {_FAR!r} THEN exp(-{a} * {a} / 2) * {_poly_sql(_TOP, a)} / {_poly_sql(_BOTTOM, a)} ELSE exp(-{a} * {a} / 2) / {far} / 2.506628274631 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {low} ELSE {low} END)"


_OPTION = (
    "o AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS z, p_retailprice AS s, p_retailprice * (0.8 + (p_partkey % 5) / 10.0) AS k, 0.1 + p_size / 100.0 AS v FROM part), "
    "d AS (SELECT *, (ln(s / k) + (0.05 - 0.01 + v * v / 2) * 1.5) / (v * sqrt(1.5)) AS d1, exp(-0.015) AS fd, exp(-0.075) AS rd FROM o), e AS (SELECT *, z * d1 AS x1, z * (d1 - v * sqrt(1.5)) AS x2 FROM d), "
    f"n AS (SELECT *, {_cdf_sql('x1')} AS n1, {_cdf_sql('x2')} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS p1 FROM e)"
)


@query(
    f"WITH {_OPTION} SELECT p_partkey, round(z * (s * fd * n1 - k * rd * n2), 6) AS price, round(z * fd * n1, 6) AS delta, round(fd * p1 / (s * v * sqrt(1.5)), 6) AS gamma, round(s * fd * p1 * sqrt(1.5), 6) AS vega, "
    "round(-s * fd * p1 * v / (2 * sqrt(1.5)) - z * (0.05 * k * rd * n2 - 0.01 * s * fd * n1), 6) AS theta, round(z * k * 1.5 * rd * n2, 6) AS rho FROM n"
)
def options_greeks(spark, d):
    o = black_scholes(*map(F.col, _ARGS))
    return _option_rows(spark, d).select("p_partkey", o.alias("o")).select("p_partkey", *(F.round(f"o.{c}", 6).alias(c) for c in ("price", "delta", "gamma", "vega", "theta", "rho")))


@query("SELECT p_partkey, round(0.1 + p_size / 100.0, 6) AS implied_vol FROM part")
def options_implied_vol(spark, d):
    rows = _option_rows(spark, d).withColumn("price", black_scholes(*map(F.col, _ARGS))["price"])
    return rows.select("p_partkey", F.round(implied_vol("right", "price", "spot", "strike", "rate", "dividend", "time"), 6).alias("implied_vol"))


_TREE = (
    "o AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS z, p_retailprice AS s, p_retailprice * (0.8 + (p_partkey % 5) / 10.0) AS k, exp((0.1 + p_size / 100.0) * sqrt(0.75)) AS u FROM part), "
    "p AS (SELECT *, (exp(0.04 * 0.75) - 1 / u) / (u - 1 / u) AS p, exp(-0.05 * 0.75) AS r FROM o), "
    "c AS (SELECT *, greatest(z * (s * u * u - k), 0) AS uu, greatest(z * (s - k), 0) AS ud, greatest(z * (s / u / u - k), 0) AS dd FROM p), "
    "b AS (SELECT *, greatest(r * (p * uu + (1 - p) * ud), z * (s * u - k)) AS up, greatest(r * (p * ud + (1 - p) * dd), z * (s / u - k)) AS down FROM c)"
)


@query(f"WITH {_TREE} SELECT p_partkey, CASE WHEN p BETWEEN 0 AND 1 THEN round(greatest(r * (p * up + (1 - p) * down), z * (s - k)), 6) END AS two_steps FROM b")
def options_american(spark, d):
    return _option_rows(spark, d).select("p_partkey", F.round(american(2)(*_ARGS), 6).alias("two_steps"))


@query()
def options_american_fifty(spark, d):
    return _option_rows(spark, d).select("p_partkey", F.round(american(50)(*_ARGS), 6).alias("value"))


@query(f"WITH x AS (SELECT p_partkey, (p_retailprice - 1400) / 25 AS x FROM part) SELECT p_partkey, round(ln({_cdf_sql('x')}), 8) AS log_p FROM x")
def options_norm_cdf(spark, d):
    """In logarithms, so that both tails count."""
    return table(spark, d, "part").select("p_partkey", F.round(F.log(norm_cdf((F.col("p_retailprice") - 1400) / 25)), 8).alias("log_p"))


# formats
@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def convert_csv_to_json(spark, d):
    n = table(spark, d, "nation")
    rec = convert.typed_fields(n.select(*(F.col(c).cast("string").alias(c) for c in n.columns)))
    return rec.select(F.col("rec")["n_nationkey"].cast("int").alias("n_nationkey"), convert.to_json_text(F.col("rec")).alias("value"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS a, p_name AS b, '' AS c FROM part")
def convert_json_to_csv(spark, d):
    p = table(spark, d, "part")
    rec = p.select("p_partkey", convert.json_fields(F.to_json(F.struct(F.col("p_partkey").alias("a"), F.col("p_name").alias("b")))).alias("rec"))
    get = lambda k: F.coalesce(convert.text_of_json(F.try_element_at("rec", F.lit(k))), F.lit("")).alias(k)
    return rec.select("p_partkey", get("a"), get("b"), get("c"))


def _document(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/document-{uuid.uuid4().hex}.{kind}"


def _as_json(*columns: str):
    """A map of JSON texts of text columns, numbers as they are."""
    return F.create_map(*(x for c in columns for x in (F.lit(c), C.json_string(F.col(c)) if not c.endswith("_id") else F.col(c).cast("string"))))


@query("SELECT doc_id, lang, text FROM documents")
def convert_csv_document(spark, d):
    """Documents, with line breaks and quotes, as one CSV file in order, read again by many tasks."""
    docs, path = table(spark, d, "documents"), _document(spark, "csv")
    sinks.write_csv_document(docs.select("doc_id", _as_json("doc_id", "lang", "text").alias("rec")), ["doc_id"], path)
    get = lambda k: convert.text_of_json(F.try_element_at("rec", F.lit(k)))
    return ranges.csv_records(spark, path).select(get("doc_id").cast("bigint").alias("doc_id"), get("lang").alias("lang"), get("text").alias("text"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row, event_id, event_type, props FROM events")
def convert_json_document(spark, d):
    """Events as one JSON array in order, nested values and all, read again by many tasks with their places."""
    e, path = table(spark, d, "events"), _document(spark, "json")
    sinks.write_json_array(e.select("event_id", F.to_json(F.struct("event_id", "event_type", F.struct(F.array(F.col("props")).alias("list")).alias("inner"))).alias("value")), ["event_id"], path)
    rows = ranges.json_elements(spark, path)
    get = lambda k: F.get_json_object("value", k)
    return rows.select("row", get("$.event_id").cast("bigint").alias("event_id"), get("$.event_type").alias("event_type"), get("$.inner.list[0]").alias("props"))


@query("SELECT line FROM (SELECT 'a_id,a_name,b_id' AS line UNION ALL SELECT s_suppkey || ',' || s_name || ',' FROM supplier UNION ALL SELECT ',' || c_name || ',' || c_custkey FROM customer)")
def collect_csv_documents(spark, d):
    """CSV files under headers of their own as one, the records typed in between."""
    paths = []
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        side = "a_id" if name == "supplier" else "b_id"
        rows = table(spark, d, name).select(F.col(key).alias(side), F.col(f"{name[0]}_name").alias("a_name"))
        paths.append(_document(spark, "csv"))
        sinks.write_csv_document(rows.select(side, _as_json("a_name", side).alias("rec")), [side], paths[-1])
    path = _document(spark, "csv")
    sinks.write_csv_document(ranges.csv_records(spark, paths), ["file", "row"], path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn) || ']' AS value FROM conversations GROUP BY conv_id")
def collect_json_array(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", convert.list_item(F.col("role")).alias("item"))
    return convert.collect_array(c, "item", "turn", "conv_id")


@query("SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name, 'region', NULL FROM region")
def collect_tables(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("region"))
    return convert.collect_tables(n, table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


#: damage to an event's props, how many repairs it takes (none: sound; null: hopeless), whether the JSON comes back
_DAMAGE = [
    ("props", 0), ("regexp_replace(props, '[}]$', ',}')", 1), ("replace(props, '\"', '''')", 1), ("replace(props, '\"', '')", 1), ("regexp_replace(props, '[}]$', '')", 1), ("replace(props, ':', ' ')", 1), ("replace(props, ':', ' =')", 1),
    ("'/* found */ ' || props", 1), ("'\ufeff' || props", 1), ("replace(props, ': ', ': +')", 1), ("replace(props, '}', '.}')", 1), ("replace(props, ': ', ': 00')", 1), ("props || ' ' || props", None), ("replace(props, ': ', ': about ')", None), ("''", None),
]


def _damage(parts: list[str]) -> str:
    return f"CASE CAST(event_id % {len(_DAMAGE)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(parts)) + " END"


@query(f"SELECT event_id, CASE WHEN event_id % {len(_DAMAGE)} < 12 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, {_damage(['NULL' if n is None else str(n) for _, n in _DAMAGE])} AS repairs, event_id % {len(_DAMAGE)} >= 12 AS hopeless FROM events")
def repair_json_props(spark, d):
    """Each event's props, damaged and repaired."""
    e = table(spark, d, "events").select("event_id", repair_json(F.expr(_damage([x for x, _ in _DAMAGE]))).alias("r"))
    return e.select("event_id", F.get_json_object("r.json", "$.k").cast("double").alias("k"), F.when(F.col("r.json").isNotNull(), F.size("r.repairs")).alias("repairs"), F.col("r.error").isNotNull().alias("hopeless"))


_NATION_ROWS = "n_nationkey || ',' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ',' || n_regionkey END || CASE WHEN n_nationkey % 7 = 1 THEN ',1' ELSE '' END"


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 1 AND n_nationkey % 3 <> 0 THEN NULL ELSE 'key,name,region' || chr(10) || n_nationkey || ',' || n_name || ',' || CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 7 = 1 THEN '1' ELSE '' END ELSE CAST(n_regionkey AS VARCHAR) END || chr(10) END AS csv, CASE WHEN n_nationkey % 7 = 1 AND n_nationkey % 3 <> 0 THEN NULL WHEN n_nationkey % 3 = 0 AND n_nationkey % 7 <> 1 THEN 1 ELSE 0 END AS repairs FROM nation")
def repair_csv_rows(spark, d):
    """A document of each nation: short rows are filled up, long ones refused."""
    n = table(spark, d, "nation").select("n_nationkey", repair_csv(F.expr(f"'key,name,region' || chr(10) || {_NATION_ROWS} || chr(10)")).alias("r"))
    return n.select("n_nationkey", F.col("r.csv").alias("csv"), F.when(F.col("r.csv").isNotNull(), F.size("r.repairs")).alias("repairs"))


@query()
def convert_yaml_round_trip(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", convert.yaml_to_json(convert.json_to_yaml("props")).alias("props"))
