from __future__ import annotations

import datetime as dt
import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import coerce, decisions, detect, options, text, times
from tidemark.operators import forecasts, judgment, paths, records, series
from tidemark.sources import convert, repair


def make(spark, *values, name="a", start=dt.datetime(2030, 1, 1)):
    rows = [(name, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, time timestamp, value double")


def values(df):
    return [r.value for r in df.orderBy("series_id", "time").collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def noise(seed, n, low=-5.0, high=5.0):
    r = random.Random(seed)
    return [round(r.uniform(low, high), 3) for _ in range(n)]


def test_steps(spark):
    x = noise(1, 40, 1, 9)
    x[7] = 0.0
    s = make(spark, *x)
    assert values(series.change(s)) == pytest.approx([(b / a - 1) * 100 for a, b in zip(x, x[1:], strict=False) if a])
    assert values(series.change(s, "log", 3)) == pytest.approx([math.log(b / a) for a, b in zip(x, x[3:], strict=False) if a and b])
    assert values(series.lag(s, 2)) == x[:-2]
    windows = [x[i : i + 6] for i in range(len(x) - 5)]
    assert values(series.rolling(s, 6)) == pytest.approx([sum(w) / 6 for w in windows])
    assert values(series.rolling(s, 6, "vol", 52.0)) == pytest.approx([statistics.stdev(w) * math.sqrt(52) for w in windows])
    assert values(series.rolling(s, 6, "zscore")) == pytest.approx([(w[-1] - sum(w) / 6) / statistics.stdev(w) for w in windows])
    assert len(values(series.rolling(make(spark, 4, 4, 4, 4, 7), 4, "zscore"))) == 1  # a flat window has none
    kept, dropped = series.keep(s, "at_least", 5)
    assert values(kept) == [v for v in x if v >= 5] and values(dropped) == [v for v in x if v < 5]
    y = noise(2, 40)
    y[3] = 0.0
    assert values(series.combine(s, make(spark, *y), "divide")) == pytest.approx([a / b for a, b in zip(x, y, strict=True) if b])
    days = [dt.datetime(2030, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    walk = noise(3, 200)
    months = {}
    for d, v in zip(days, walk, strict=True):
        months.setdefault((d.year, d.month), []).append(v)
    assert values(series.resample(make(spark, *walk), "monthly")) == [m[-1] for m in months.values()]
    assert values(series.resample(make(spark, *walk), "monthly", "sum")) == pytest.approx([sum(m) for m in months.values()])


@pytest.mark.parametrize("bad", ["null", "nan", "infinite", "twice"])
def test_steps_refuse_bad_series(spark, bad):
    """Each step by itself, not only where it is asked to check."""
    wrong = {"null": None, "nan": math.nan, "infinite": math.inf, "twice": 1.0}[bad]
    s = make(spark, 3, 2, wrong, 5, 6)
    if bad == "twice":
        s = s.union(make(spark, 9))
    good = make(spark, 1, 2, 4, 3, 5)
    steps = [lambda: series.change(s), lambda: series.lag(s, 1), lambda: series.rolling(s, 2), lambda: paths.drawdown(s), lambda: paths.returns(s)]
    if bad != "twice":
        steps += [lambda: series.resample(s, "daily"), lambda: series.summarize(s, "max"), lambda: series.keep(s, "above", 0.0)[0], lambda: series.combine(good, s, "add"), lambda: series.align(good, s), lambda: paths.zscores(s), lambda: series.describe(s)]
    for step in steps:
        with pytest.raises(Exception, match="NOT_A_SERIES"):
            step().collect()


def test_refusals(spark):
    for bad in (make(spark, 1, None), make(spark, 1, float("nan")), make(spark, 1).union(make(spark, 2))):
        with pytest.raises(Refused, match="NOT_A_SERIES"):
            series.check(bad)
    s = make(spark, 1, 2, 3)
    for call, code in [
        (lambda: series.resample(s, "hourly"), "NOT_A_CHOICE"), (lambda: series.lag(s, 0), "NOT_A_COUNT"), (lambda: series.rolling(s, 3, "vol"), "NOT_DEFINED"), (lambda: series.rolling(s, 3, "mean", 365), "NOT_DEFINED"),
        (lambda: series.align(s), "TOO_FEW_SERIES"), (lambda: series.regress(s), "REGRESSOR_REQUIRED"), (lambda: records.validate([]), "NOT_A_PROGRAM"), (lambda: records.validate([{"op": "sum"}]), "NOT_A_PROGRAM"),
        (lambda: records.validate([{"op": "filter", "field": "a", "predicate": "eq"}]), "NOT_A_PROGRAM"), (lambda: records.validate([{"op": "filter", "field": "b", "predicate": "exists"}], ["a"]), "NOT_A_PROGRAM"),
        (lambda: records.validate([{"op": "reverse", "by": "a"}]), "NOT_A_PROGRAM"), (lambda: records.validate([{"op": "filter", "field": "a", "predicate": "exists", "value": 1}]), "NOT_A_PROGRAM"),
    ]:
        with pytest.raises(Refused) as e:
            call()
        assert e.value.code == code
    with pytest.raises(Exception, match="NOT_DEFINED"):
        series.correlate(s, make(spark, 5, 5, 5)).collect()
    with pytest.raises(Exception, match="NOT_DEFINED"):
        series.regress(s, make(spark, 1, 2))[0].collect()


def test_regression_and_paths(spark):
    x = np.array([noise(i, 25) for i in (11, 12, 13)])
    y = 0.7 + np.array([1.3, -2.1, 0.4]) @ x + np.array(noise(14, 25, -0.3, 0.3))
    out, residuals = series.regress(make(spark, *y), *(make(spark, *v) for v in x))
    full = np.column_stack([np.ones(25), x.T])
    b, *_ = np.linalg.lstsq(full, y, rcond=None)
    rest = y - full @ b
    row = out.first()
    assert [row.alpha, *row.betas] == pytest.approx(b.tolist()) and values(residuals) == pytest.approx(rest.tolist(), abs=1e-9)
    assert [row.r_squared, row.residual_std] == pytest.approx([1 - rest @ rest / ((y - y.mean()) @ (y - y.mean())), math.sqrt(rest @ rest / 21)])
    p, q = np.exp(np.cumsum(noise(15, 60, -0.1, 0.1))), np.exp(np.cumsum(noise(16, 60, -0.1, 0.1)))
    path, other = make(spark, *p), make(spark, *q)
    assert paths.growth(path).first().total_return == pytest.approx(p[-1] / p[0] - 1)
    fall = 1 - p / np.maximum.accumulate(p)
    deep, low = paths.drawdown(path).first(), int(fall.argmax())
    day = lambda i: dt.datetime(2030, 1, 1) + dt.timedelta(days=int(i))
    assert deep.depth == pytest.approx(fall.max()) and (deep.trough_time, deep.peak_time) == (day(low), day(p[: low + 1].argmax()))
    r, m = p[1:] / p[:-1] - 1, q[1:] / q[:-1] - 1
    tail = paths.tail(paths.returns(path), 0.9).first()
    assert [tail.value_at_risk, tail.expected_shortfall] == pytest.approx([-np.quantile(r, 0.1), -r[r <= np.quantile(r, 0.1)].mean()])
    e = paths.relative(path, other).first()
    up, down = m > 0, m < 0
    want = [(r - m).mean(), np.cov(r, m)[0, 1] / m.var(ddof=1), np.corrcoef(r, m)[0, 1], r[up].mean() / m[up].mean(), r[down].mean() / m[down].mean()]
    assert [e.excess_return, e.beta, e.correlation, e.up_capture, e.down_capture] == pytest.approx(want)
    rate, net = noise(17, 30, 0, 8), [80.0]
    x = noise(18, 30, 5, 90)  # prices at or below 0 refuse
    x[0] = 80.0
    for i in range(1, 30):
        net.append(net[-1] * (x[i] / x[i - 1] - ((1 + rate[i - 1] / 100) ** (1 / 365.25) - 1)))
    assert values(paths.excess(make(spark, *x), make(spark, *rate))) == pytest.approx(net)


def test_as_of(spark):
    left = make(spark, 0, 0, start=dt.datetime(2029, 12, 31, 12)).withColumnRenamed("value", "x")
    got = series.as_of(left, make(spark, 7, 8)).orderBy("time").collect()
    assert [r.as_of_value for r in got] == [None, 7] and got[0].x == 0


def test_record_programs(spark):
    rows = [("Bo", " x ", 3, 1.0), ("al", "ü ", None, 2.0), (None, "z", 1, 2.0), ("Cy", "q", 2, 1.0)]
    df = records.numbered(spark.createDataFrame(rows, "name string, note string, n bigint, w double").coalesce(1).withColumn("i", F.monotonically_increasing_id()), "i")
    run = lambda *steps: [tuple(r)[:1][0] for r in records.run(df, list(steps)).orderBy("pos").collect()]
    by = lambda field, order: {"op": "sort_by", "field": field, "order": order}
    keep = lambda field, predicate, **value: {"op": "filter", "field": field, "predicate": predicate, **value}
    assert run(by("w", "desc")) == ["al", None, "Bo", "Cy"]
    assert run(by("n", "asc"), {"op": "reverse"}) == ["Bo", "Cy", None, "al"]
    assert run(by("n", "desc"), {"op": "limit", "n": 3}) == ["Bo", "Cy", None]
    assert run(by("n", "desc"), {"op": "set_field", "field": "n", "value": 0}, {"op": "drop_fields", "fields": ["w"]}, {"op": "reverse"}) == ["al", None, "Cy", "Bo"]
    assert run(keep("n", "ne", value=3)) == [None, "Cy"]
    assert run(keep("w", "eq", value=1)) == []  # 1 and 1.0 differ
    assert run({"op": "select_fields", "fields": ["note", "absent"]}, {"op": "map_field", "field": "note", "transform": "trim"}) == ["x", "ü", "z", "q"]
    assert run({"op": "rename_field", "from": "note", "to": "name"}, {"op": "select_fields", "fields": ["name"]}) == [" x ", "ü ", "z", "q"]
    assert run({"op": "select_fields", "fields": ["n"]}, {"op": "map_field", "field": "n", "transform": "to_string"}) == ["3", "null", "1", "2"]
    assert records.rows(df, [by("w", "desc")]).columns == ["name", "note", "n", "w", "i"]
    with pytest.raises(Refused, match="NOT_APPLICABLE"):
        records.run(df, [keep("name", "gt", value=1)])
    with pytest.raises(Exception, match="not a number"):
        records.run(df, [{"op": "map_field", "field": "name", "transform": "to_number"}]).collect()
    assert [r.i for r in records.every_nth(df, 3).orderBy("i").collect()] == [0, 3]
    assert records.schema_of(["a"])["properties"]["ops"]["maxItems"] == 32


def test_order_of_many_rows_in_many_files(spark, tmp_path):
    """Numbers must come from the very partitions that hold the rows."""
    n, path = 3_000_000, str(tmp_path / "rows")
    spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("k"), F.col("id").alias("i")).repartition(12).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = records.numbered(spark.read.parquet(path), "k", "i")
        w = np.lexsort((i := np.arange(n), k := np.empty(n, np.int64)))
        table = spark.read.parquet(path).toPandas()
        k[table["i"].to_numpy()] = table["k"].to_numpy()
        w = np.lexsort((i, k))
        got = records.every_nth(df, 7).select("i").toPandas()["i"].to_numpy()
        assert sorted(got) == sorted(w[::7])
        back = records.run(df, [{"op": "sort_by", "field": "i", "order": "asc"}, {"op": "reverse"}]).select("i", F.col("pos.n").alias("n")).toPandas()
        assert (back["n"].to_numpy() == n - 1 - back["i"].to_numpy()).all() and len(back) == n
        tail = records.rows(df, [{"op": "reverse"}, {"op": "limit", "n": 1000}]).select("i").toPandas()["i"].tolist()
        assert tail == w[::-1][:1000].tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_coercions(spark):
    c = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i")
    got = lambda df, f: [r[0] for r in df.select(f(F.col("x"))).collect()]
    said = {True: ("true", "1", "yes", "on"), False: ("false", "0", "no", "off")}
    shapes = [str, str.upper, str.title, lambda w: f"\t{w}  "]
    words = [(f(w), v) for v, ws in said.items() for w in ws for f in shapes] + [(w, None) for w in ("y", "tru", "11", "no way", "", None)]
    assert got(c(*(w for w, _ in words)), coerce.text_to_boolean) == [v for _, v in words]
    numbers = noise(21, 30, -1e6, 1e6)
    half_away = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
    assert got(c(*map(str, numbers)), coerce.text_to_integer) == [half_away(x) for x in numbers]
    assert got(c("8e99", "-8E99", "-Infinity", "NaN", "seven", "9007199254740995"), coerce.text_to_integer) == [coerce.MAX, coerce.MIN, coerce.MIN, 0, None, 9007199254740995]
    assert got(c(" 17", "2.50", "+6e2", "12kg", "0b1", "-inf"), coerce.text_to_number) == ["17", "2.5", "600", None, None, None]
    r = random.Random(22)
    fields = [str(r.randrange(-999, 999)) for _ in range(30)] + [f"{r.randrange(99)}.{r.randrange(1, 10)}" for _ in range(30)] + [f"{'0' * r.randrange(1, 3)}{r.randrange(1, 99)}" for _ in range(10)] + ["yes", "False", "true", "-0", "8.", "5.0e3", "", None]

    def inferred(f):
        if not f:
            return "null"
        try:
            value = json.loads(f)
        except ValueError:
            return json.dumps(f)
        return f if isinstance(value, bool) or (f != "-0" and str(value) == f) else json.dumps(f)

    assert got(c(*fields), coerce.infer_csv) == [inferred(f) for f in fields]
    row = one(spark, coerce.nested_to_text(F.array(F.lit("b"))).alias("a"), coerce.to_object(F.lit(4), "integer").alias("b"))
    assert row == ('"[\\"b\\"]"', '{"source_type":"integer","value":4}')


def test_number_text(spark):
    r = random.Random(23)
    doubles = [0.0, 1.0, -2.5, 1e39, -1e-30, 1.5e-20, 5e-324, 1.7976931348623157e308] + [r.choice([-1, 1]) * r.random() * 10.0 ** r.randrange(-40, 40) for _ in range(200)]
    got = [x.t for x in spark.createDataFrame([(i, d) for i, d in enumerate(doubles)], "i int, d double").select("i", text.number_text(F.col("d")).alias("t")).orderBy("i").collect()]
    assert not any("e" in t.lower() or t.endswith(".") or t.endswith(".0") for t in got) and [float(t) for t in got] == doubles


def test_times(spark):
    c = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i")
    good = c("2019-11-30", "2019-11-30T23:59:01Z", "2019-11-30T23:59:01.500-02:30", "30.11.2019", "2019-11", "2019-11-30 23:59", None)
    assert [r[0] for r in good.select(times.format_instant(times.parse_instant(F.col("x")))).collect()] == ["2019-11-30T00:00:00Z", "2019-11-30T23:59:01Z", "2019-12-01T02:29:01.500Z", None, None, None, None]
    labels = {}
    for y in (1999, 2024):
        labels |= {f"FY{y}": ("FY", None, None), f"CY{y}": ("CY", dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1))}
        for q in range(1, 5):
            labels |= {f"CY{y}Q{q}": ("CY", dt.datetime(y, 3 * q - 2, 1), dt.datetime(y + q // 4, 3 * q % 12 + 1, 1)), f"FY{y}Q{q}": ("FY", None, None)}
        for m in range(1, 13):
            labels |= {f"{y}-{m:02}": ("MONTH", dt.datetime(y, m, 1), dt.datetime(y + m // 12, m % 12 + 1, 1)), f"{y}-{m:02}-28": ("DAY", dt.datetime(y, m, 28), dt.datetime(y, m, 28) + dt.timedelta(days=1))}
    wrong = [f"{k}{y}{q}" for k in ("XY", "FY", "") for y in ("201", "2019") for q in ("Q0", "q1", "-00", "-1")]
    p = [r[0] for r in c(*labels, *wrong).select(times.period(F.col("x"))).collect()]
    assert [(x.kind, x.start, x.end) if x else None for x in p] == [*labels.values(), *[None] * len(wrong)]
    start, end = dt.datetime(2022, 5, 4), dt.datetime(2022, 6, 1)
    assert [r[0] for r in spark.createDataFrame([(0, start), (1, end), (2, end - dt.timedelta(seconds=1)), (3, start - dt.timedelta(seconds=1))], "i int, t timestamp").orderBy("i").select(times.valid_at(F.lit(start), F.lit(end), F.col("t"))).collect()] == [True, False, True, False]


def test_text(spark):
    content = F.lit("one  two\n three")
    row = one(spark, text.grounded(F.array(F.lit("two three")), content), text.grounded(F.array(F.lit("four")), content), text.grounded(F.array(F.lit(" ")), content))
    assert list(row) == [True, False, False]
    assert text.labels("a, b\nc") == ["a", "b", "c"] and text.scale("-1..5") == (-1, 5) and list(text.targets('{"b": "x", "a": "y"}')) == ["a", "b"]
    for call in (lambda: text.labels("a,a"), lambda: text.scale("5..1"), lambda: text.targets('{"a": "x"}')):
        with pytest.raises(Refused):
            call()
    assert text.outline({"properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"properties": {"c": {"type": "integer"}}}}}, "required": ["a"]}) == "a: string\nb?: array\n  c?: integer"


def test_detect(spark):
    cases = [("json", ' {"a":1}', "json;record"), ("json", "[ {}]", "json;list;record"), ("json", "[]", "json;list"), ("json", "1", "json"), ("jsonl", '\n{"a":1}', "ndjson;list;record"), ("csv", "x", "csv;list;record"), ("yml", "a: 1", "yaml;record"), ("yaml", "- a\n- b", "yaml;list"), ("yaml", "- a: 1", "yaml;list;record"), ("toml", "x=1", "toml"), ("xml", "<?xml?><r><a/></r>", "xml;record"), ("bin", "x", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, t string, want string")
    for r in df.select("want", detect.detect(F.col("t"), F.col("e")).alias("got")).collect():
        assert (r.got[0] if r.got else None) == r.want


def test_forecasts(spark):
    r = random.Random(31)
    said = [(r.randrange(10001) / 10000, r.random() < 0.6) for _ in range(150)]
    df = spark.createDataFrame(said, "probability double, came_true boolean")
    s = forecasts.score(forecasts.checked(df)).first()
    want = sum((p - c) ** 2 for p, c in said) / 150
    assert s.n == 150 and s.beats_even == (want < 0.25) and s.brier == pytest.approx(want, abs=2e-4)
    tenths = {}
    for p, c in said:
        tenths.setdefault(min(round(p * 10000) // 1000, 9), []).append(c)
    assert [(x.tenth, x.forecasts, x.came_true) for x in forecasts.calibration(df).orderBy("tenth").collect()] == [(t, len(v), sum(v)) for t, v in sorted(tenths.items())]
    for bad, code in (([(1.5, True)], "NOT_A_PROBABILITY"), ([(None, True)], "NOT_OUTCOMES"), ([], "NOTHING_TO_SCORE")):
        with pytest.raises(Refused, match=code):
            forecasts.checked(spark.createDataFrame(bad, df.schema))
    b = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<boolean>")
    row = one(spark, decisions.settle("at_deadline", F.lit(True), b(True, False)), decisions.settle("any_time", F.lit(True), b(True, False)), decisions.settle("at_deadline", F.lit(True), b()), decisions.settle("any_time", F.lit(False), b(False)), decisions.floor_div(F.lit(-7), 2))
    assert list(row) == ["did_not", "came_true", "void", "open", -4]


def plain_tree(sign, spot=100.0, strike=100.0, rate=0.05, vol=0.2, steps=500):
    """An American option's value over a year, backwards through a recombining tree."""
    dt_ = 1 / steps
    up = math.exp(vol * math.sqrt(dt_))
    p = (math.exp(rate * dt_) - 1 / up) / (up - 1 / up)
    pays = lambda n, i: max(sign * (spot * up ** (2 * i - n) - strike), 0.0)
    held = [pays(steps, i) for i in range(steps + 1)]
    for n in range(steps - 1, -1, -1):
        held = [max(pays(n, i), math.exp(-rate * dt_) * (p * held[i + 1] + (1 - p) * held[i])) for i in range(n + 1)]
    return held[0]


def test_options(spark):
    args = lambda right, v=0.2: [F.lit(right), *(F.lit(float(x)) for x in (100, 100, 0.05, 0, v, 1))]
    call, put = one(spark, options.black_scholes(*args("call")).alias("c"), options.black_scholes(*args("put")).alias("p"))
    assert call.price == pytest.approx(10.450583572185565, abs=1e-10) and put.price == pytest.approx(5.573526022256971, abs=1e-10)
    assert call.price - put.price == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-10)
    assert list(one(spark, *(options.norm_cdf(F.lit(x)) for x in (0.0, 1.96, -3.0, 40.0)))) == pytest.approx([0.5, 0.9750021048517795, 0.0013498980316300933, 1.0], abs=1e-14)
    df = spark.createDataFrame([("call", 10.450583572185565), ("call", 200.0), ("put", 5.573526022256971)], "right string, price double")
    flat = [F.lit(float(x)) for x in (100, 100, 0.05, 0, 1)]
    got = [r[0] for r in df.select(options.implied_vol("right", "price", *flat)).collect()]
    assert got[1] is None and [got[0], got[2]] == pytest.approx([0.2, 0.2], abs=1e-9)
    am = [r[0] for r in df.select(options.american(500)("right", F.lit(100.0), F.lit(100.0), F.lit(0.05), F.lit(0.0), F.lit(0.2), F.lit(1.0))).collect()]
    assert [am[0], am[2]] == pytest.approx([plain_tree(1), plain_tree(-1)], rel=1e-9)


#: kind of damage -> text, JSON, places of the repairs (none of either: hopeless)
REPAIRS = {
    "mark": ("\ufeff[7]", [7], [0]), "line comment": ('[7] // seven', [7], [4]), "block comment": ('/* é */[7]', [7], [0]), "open comment": ('[7] /* s', [7], [4]), "single quotes": ("['it']", ["it"], [1]), "key": ("{it: 7}", {"it": 7}, [1]), "equals": ('{"it" = 7}', {"it": 7}, [6]),
    "colon": ('{"it" 7}', {"it": 7}, [6]), "comma in object": ('{"i": 7 "t": 8}', {"i": 7, "t": 8}, [8]), "comma in array": ("[7 8 9]", [7, 8, 9], [3, 5]), "trailing": ('{"i": [7,],}', {"i": [7]}, [8, 10]), "leading": ("[,7]", [7], [1]), "leading in object": ('{, "i": 7}', {"i": 7}, [1]),
    "same key": ('{"i": 7, "i": 8}', {"i": 8}, [9]), "words": ("[True, False, None, undefined, NaN, Infinity, -Infinity]", [True, False, *[None] * 5], [1, 7, 14, 20, 31, 36, 46]), "plus": ("[+7]", [7], [1]), "point": ("[7.]", [7.0], [1]), "zeros": ("[007]", [7.0], [1]), "signed point": ("[-.5]", [-0.5], [1]),
    "escape": (r'["a\qb"]', ["aqb"], [4]), "control": ('["a\tb"]', ["a\tb"], [3]), "open object": ('{"i": 7', {"i": 7}, [7]), "open array": ("[[7", [[7]], [3, 3]), "open string": ('["é', ["é"], [4, 4]), "open line": ('["a\n, 7]', ["a", 7], [3]), "backslash": ('["a\\', ["a"], [4, 4]), "pair": (r"['\ud83c\udf0a']", ["🌊"], [1]),
    "sound": ('{"it\'s": ["//", 7e2, null]}', {"it's": ["//", 700.0, None]}, []), "trailing text": ("[7] 8", None, None), "word": ("[seven]", None, None), "empty": (" ", None, None), "number": ("[7-7]", None, None), "huge": ("[+7e999]", None, None), "half a pair": (r"['\ud83c']", None, None), "no key": ("{[7]: 8}", None, None), "no value": ('{"i":', None, None), "deep": ("[" * 200, None, None),
}


def test_repair(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in REPAIRS.items()] + [("null", None)], "k string, t string")
    for r in df.select("k", "t", repair.repair_json(F.col("t")).alias("r")).collect():
        if r.k == "null":
            assert r.r.json is None and r.r.error is None
            continue
        _, want, places = REPAIRS[r.k]
        if places is None:
            assert r.r.json is None and " at byte " in r.r.error, r
        else:
            assert json.loads(r.r.json) == want and [x.position for x in r.r.repairs] == places and r.r.error is None, r
    row = one(spark, repair.repair_row(F.array(F.lit("a")), 3, F.lit(2)))
    assert row[0] == ["a", "", ""]
    csvs = {'\ufeffé,b,c\n1,2\n\n"x\ny",5,"6"\n7\n': ("é,b,c\n1,2,\n\"x\ny\",5,6\n7,,\n", [0, 10, 27]), "a,b\n1,2,3\n": None, "": None}
    for r in spark.createDataFrame([(t,) for t in csvs], "t string").select("t", repair.repair_csv(F.col("t")).alias("r")).collect():
        want = csvs[r.t]
        assert (r.r.csv is None and r.r.error) if want is None else (r.r.csv, [x.position for x in r.r.repairs]) == want


def test_damaged_documents(spark):
    """Random sound documents, cut off anywhere or damaged by rule, come back as they were or are called hopeless."""
    r = random.Random(41)

    def value(depth):
        kind = r.randrange(6 if depth else 4)
        if kind == 4:
            return {f"k{i}": value(depth - 1) for i in range(r.randrange(4))}
        return [value(depth - 1) for _ in range(r.randrange(4))] if kind == 5 else [r.randrange(999), round(r.random(), 4), r.choice([True, None]), r.choice(["plain", "é ü", 'a "b" \\ c'])][kind]

    for _ in range(300):
        v = [value(3), {"z": value(2)}]
        t = json.dumps(v, ensure_ascii=False)
        assert repair.repaired(t) == (t, [], None)
        loose = t.replace("]", ",]").replace("[,]", "[]")
        got, notes, error = repair.repaired(loose)
        assert json.loads(got) == v and len(notes) == loose.count(",]") and not error
        got, notes, error = repair.repaired(t[: r.randrange(1, len(t))])
        assert (error and not got) or (notes and isinstance(json.loads(got), list))


def test_formats(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿id,name,score\n007,"a ""q""",1.5\n8,,true\n', encoding="utf-8")
    rec = convert.read_csv(spark, str(tmp_path / "in.csv"))
    assert [r[0] for r in rec.select(convert.to_json_text(F.col("rec"))).collect()] == ['{"id":"007","name":"a \\"q\\"","score":1.5}', '{"id":8,"name":null,"score":true}']
    convert.write_json(rec, str(tmp_path / "out"))
    back = convert.read_json(spark, str(tmp_path / "out"))
    assert {tuple(sorted(r.rec.items())) for r in back.collect()} == {tuple(sorted(r.rec.items())) for r in rec.collect()}
    convert.write_csv(back, str(tmp_path / "csv"))
    assert convert.header(back) == ["id", "name", "score"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert [r[0] for r in spark.createDataFrame([("1",), ("x y",), ('{"a":1}',)], "v string").select(convert.list_item(F.col("v"))).collect()] == ["1", '"x y"', '{"a":1}']


def test_judgment(spark):
    def provider(requests):
        return [json.dumps({"label": "good" if "fine" in p else "odd", "confidence": 0.9, "reason": "r"}) for p, _ in requests]

    df = spark.createDataFrame([(1, "fine day"), (2, "bad day")], "id int, text string")
    got = judgment.judge(df, "classify", "text", F.lit("Label it."), provider, allowed=["good", "bad"]).orderBy("id").collect()
    assert got[0].reply.label == "good" and got[0].error is None and got[1].reply is None and got[1].error.startswith("INVALID_REPLY")
    with pytest.raises(Refused, match="INPUT_REQUIRED"):
        judgment.judge(df, "route", "text", F.lit("x"), provider)


def test_answers_of_any_form(spark):
    df = spark.createDataFrame([(1, "seven"), (2, "nothing")], "id int, text string")
    made = judgment.generate_json(df, "text", {"type": "object", "properties": {"n": {"type": "integer"}}}, F.lit("?"), lambda rs: ['{"n": 7}' if "seven" in p else "none" for p, _ in rs]).orderBy("id").collect()
    assert made[0].reply == '{"n": 7}' and made[0].error is None and made[1].reply is None and made[1].error.startswith("INVALID_REPLY")
    got = judgment.extract(df, "text", {"type": "array", "items": {"type": "integer"}}, F.lit("?"), lambda rs: [json.dumps({"result": [7], "confidence": 1, "reason": "r"} if "seven" in p else {"confidence": 1, "reason": "r"}) for p, _ in rs]).orderBy("id").collect()
    assert got[0].reply.result == "[7]" and got[0].reply.confidence == 1 and got[1].reply is None
    table = records.numbered(df, "id")
    asked = []

    def programmer(requests):
        asked.extend(requests)
        return ['{"ops": [{"op": "map_field", "field": "text", "transform": "uppercase"}, {"op": "reverse"}]}']

    out, steps = judgment.edit_records(table, "Shout, last one first", programmer)
    assert [r.text for r in out.orderBy("pos").collect()] == ["NOTHING", "SEVEN"] and len(steps) == 2 and len(asked) == 1 and "seven" not in asked[0][0] and "text: string" in asked[0][0]
    with pytest.raises(Refused, match="NOT_A_PROGRAM"):
        judgment.edit_records(table, "x", lambda rs: ['{"ops": [{"op": "drop_fields", "fields": ["none"]}]}'])
    for bad in (lambda: judgment.edit_records(table, " ", programmer), lambda: judgment.decide_many(df, "text", [""], F.lit("?"), programmer)):
        with pytest.raises(Refused, match="INPUT_REQUIRED"):
            bad()


def test_small_systems():
    from tidemark.functions.linear import cholesky, solve_spd

    g = np.random.default_rng(5)
    m = g.normal(size=(20, 4, 6))
    a, b = m @ np.swapaxes(m, 1, 2), g.normal(size=(20, 4))
    x, good = solve_spd(a, b)
    assert good.all() and np.allclose(np.einsum("nij,nj->ni", a, x), b)
    flat = np.array([[[1.0, 1.0], [1.0, 1.0]], [[2.0, 0.0], [1.0, 2.0]], [[-1.0, 0.0], [0.0, 1.0]], [[2.0, 1.0], [1.0, 2.0]]])
    assert cholesky(flat)[1].tolist() == [False, False, False, True]  # no rank, not symmetric, a negative pivot


def test_lines(spark, tmp_path):
    lists = ['["a", 1, 2.50, null, true, {"b": [1]}, "é\\n"]', "[]", "{}", "x", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x string").orderBy("i").select(convert.lines_of_json(F.col("x"))).collect()]
    assert got == [["a", "1", "2.5", "null", "true", '{"b":[1]}', "é\n"], [], None, None, None]
    lines = ["plain", 'a "b", c', "", "x"]
    convert.lines_to_csv(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), str(tmp_path / "csv"))
    assert [r.value for r in convert.csv_to_lines(spark, str(tmp_path / "csv")).collect()] == lines
    (tmp_path / "in.csv").write_text('\ufeffname,n\nAda,1\n,2\n"Bo\nb",3\n', encoding="utf-8")
    assert [r.value for r in convert.csv_to_lines(spark, str(tmp_path / "in.csv")).collect()] == ["Ada", "", "Bo\nb"]


def test_checked_times(spark):
    far = F.timestamp_micros(F.lit(times.MICROS_MAX))
    row = one(spark, times.since(far, F.timestamp_micros(F.lit(-5))).alias("a"), F.unix_micros(times.plus(F.timestamp_micros(F.lit(7)), -9)).alias("b"), times.plus(far, 1).isNull().alias("c"), times.days(F.lit(43_200_000_000)).alias("d"), times.year_before(F.lit(2024), F.lit(3)).alias("e"))
    assert (row.a, row.b, row.c, row.d, tuple(row.e)) == (times.MICROS_MAX, -2, True, 0.5, (2023, 3))


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
