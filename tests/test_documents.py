"""Large single documents: read by ranges, written in order, and the texts of numbers in them."""

from __future__ import annotations

import csv
import io
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import coerce, text
from tidemark.sources import convert, ranges, sinks


@pytest.fixture
def sized(spark):
    """Sets the size of ranges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def rust_like(d):
    """Shortest digits; plain from 1e-5 to below 1e16, else with an exponent."""
    m, e = (repr(abs(d)).split("e") + ["0"])[:2]
    a, b = (m.split(".") + [""])[:2]
    digits, k = (a + b).lstrip("0"), int(e) - len(b)
    k += len(digits) - len(digits.rstrip("0"))
    digits = digits.rstrip("0")
    sign, at = "-" if str(d).startswith("-") else "", len(digits) + k
    if not digits:
        return f"{sign}0.0"
    if 1e-5 <= abs(d) < 1e16:
        return sign + (digits + "0" * k + ".0" if k >= 0 else digits[:at] + "." + digits[at:] if at > 0 else "0." + "0" * -at + digits)
    return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{at - 1}"


def test_json_numbers(spark):
    r = random.Random(1)
    ds = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(1_500)] + [round(r.uniform(-1e4, 1e4), r.randint(0, 5)) for _ in range(500)]
    ds += [s * 10.0**i for i in range(-30, 30) for s in (1, -1, 1.5)] + [0.0, -0.0, 5e-324, 2e-3, 2.5e-5, 1e23, 2.0**70]
    for row in spark.createDataFrame([(d,) for d in ds], "d double").select("d", text.json_number_text(F.col("d")).alias("t")).collect():
        assert row.t == (None if row.d != row.d or abs(row.d) == float("inf") else rust_like(row.d))


def test_infer_decimals(spark):
    fields = "12345678.5 0.0005 10000000.0 0.00001 0.000001 1e-6 1e16 1e15 1000000000000000.0 10000000000000000.0 1.5e300 1e5 1.50 -0.0 0.0 0.1 0.10 123456789.123456789 5e-324 4.94e-324 1e400 1e-400 0.30000000000000004 9007199254740993.0 -3.25 3.0e10 00.5 .5 5. 7e-10 1.0e20 0.00 -0 42 007 1E5 1e+20 9223372036854775808 Infinity NaN true".split()

    def want(f):
        try:
            if str(int(f)) == f and abs(int(f)) < 2**63 or rust_like(float(f)) == f:
                return f
        except (ValueError, OverflowError):
            try:
                if rust_like(float(f)) == f:
                    return f
            except (ValueError, OverflowError):
                pass
        return f if f == "true" else json.dumps(f)

    got = spark.createDataFrame([(f,) for f in fields], "f string").select("f", coerce.infer_csv(F.col("f")).alias("j")).collect()
    assert {r.f: r.j for r in got} == {f: want(f) for f in fields}


def _rows(r, n):
    def field():
        k = r.random()
        return str(r.randint(0, 99)) if k < 0.3 else "" if k < 0.4 else "".join(r.choices(["a", '"', ",", "\n", "é", " ", "x", '""', '"\n"'], k=r.randint(0, 12)))

    return [[field() for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("size", ["1k", "20k", "8m"])
def test_csv_by_ranges(spark, tmp_path, sized, size):
    r = random.Random(4)
    rows = [*_rows(r, 400), ["long", '\n,"' * 20_000, "z"], *_rows(r, 300)]
    for name, ending in (("a.csv", "\n"), ("b.csv", "\r\n")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig") as f:
            w = csv.writer(f, lineterminator=ending)
            w.writerow(["k", "k,2", "k"])
            w.writerows(rows)
            f.write(ending + ending)  # blank lines are no records
    sized(size)
    got = ranges.csv_rows(spark, str(tmp_path)).orderBy("file", "row").collect()
    assert [x.fields for x in got] == [["k", "k,2", "k"], *rows] * 2
    assert [x.row for x in got] == [*range(len(rows) + 1)] * 2
    recs = ranges.csv_records(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    plain = lambda v: "" if v == "null" else json.loads(v) if v.startswith('"') else v
    assert [(x.row, {k: plain(v) for k, v in x.rec.items()}) for x in recs] == [(i, {"k": x[2], "k,2": x[1]}) for i, x in enumerate(rows, 1)]


def test_odd_csv(spark, tmp_path, sized):
    sized("1k")
    path = tmp_path / "a.csv"
    path.write_bytes(b'a,b\n1,x"y"z\n"p"q,"r\n')
    assert [x.fields for x in ranges.csv_rows(spark, str(path)).orderBy("row").collect()] == [["a", "b"], ["1", 'x"y"z'], ["pq", "r"]]  # a quote that is never closed ends with the file
    path.write_bytes(b"a,b\n" + b"1,2\n" * 700 + b"3\n")
    with pytest.raises(Exception, match="row 701 of .* has 1 fields, its header 2"):
        ranges.csv_records(spark, str(path)).collect()
    path.write_bytes(b"a\n\xff\n")
    with pytest.raises(Exception, match="NOT_TEXT"):
        ranges.csv_rows(spark, str(path)).collect()
    path.write_bytes(b"")
    assert ranges.csv_records(spark, str(path)).count() == 0
    path.write_bytes(b"a;b\n1;2\n")
    assert convert.read_csv(spark, str(path), sep=";").first().rec == {"a": "1", "b": "2"}
    path.write_bytes(b'\xef\xbb\xbfname,b\n"x\ny",2\n"",3\n')
    assert [x.value for x in convert.csv_to_lines(spark, str(path)).collect()] == ["x\ny", ""]


@pytest.mark.parametrize("size", ["2k", "8m"])
def test_json_by_ranges(spark, tmp_path, sized, size):
    r = random.Random(5)
    shapes = [1, "a,]b", 'x\\"[,', {"k": [1, {"z": "}"}], "m": "é,"}, [], [[1, 2], [3]], None, True, -1.5, "\\", "\\,", {}]
    items = [r.choice(shapes) for _ in range(1_200)] + ["y," * 9_000, {"q": list(range(3_000))}, 7]
    sized(size)
    path = tmp_path / "a.json"
    for shown in (json.dumps(items, ensure_ascii=False), json.dumps(items, indent=1)):
        path.write_text("﻿ " + shown + "\n")
        got = ranges.json_elements(spark, str(path)).orderBy("row").collect()
        assert [json.loads(x.value) for x in got] == items and [x.row for x in got] == [*range(len(items))]
    for shown, want in (("[]", []), (" [ \n] \n", []), ("[[]]", [[]]), ("[1]", [1])):
        path.write_text(shown)
        assert [json.loads(x.value) for x in ranges.json_elements(spark, str(path)).collect()] == want


@pytest.mark.parametrize("shown", ["[1", "[1,]", "1,2", "[1],2", "[1,,2]", "[1] x", '["a]', "[{]}", "", "[1}"])
def test_no_json_array(spark, tmp_path, shown):
    (tmp_path / "a.json").write_text(shown)
    with pytest.raises(Exception, match="INVALID_INPUT|Refused"):
        ranges.json_elements(spark, str(tmp_path / "a.json")).collect()


def test_documents_in_order(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, *x) for i, x in enumerate(_rows(r, 500))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "value int, b string, a string, c string").repartition(7)
    rec = df.select("value", F.create_map(*(x for c in ("b", "a") for x in (F.lit(c), coerce.json_string(F.col(c)))), F.lit("n"), F.when(F.col("value") % 2 == 0, F.col("value").cast("string")).otherwise("null")).alias("rec"))
    sinks.write_csv_document(rec, ["value"], str(tmp_path / "a.csv"), null="null")
    want = io.StringIO()
    w = csv.writer(want, lineterminator="\n")
    w.writerow(["a", "b", "n"])
    w.writerows([a, b, i if i % 2 == 0 else "null"] for i, b, a, _ in rows)
    assert (tmp_path / "a.csv").read_text(newline="") == want.getvalue()
    items = rec.select("value", convert.to_json_text(F.col("rec")).alias("item"))
    sinks.write_json_array(items, [("value", True)], str(tmp_path / "a.json"), value="item")
    shown = (tmp_path / "a.json").read_text()
    assert json.loads(shown) == [{"a": a, "b": b, "n": i if i % 2 == 0 else None} for i, b, a, _ in rows[::-1]]
    sinks.write_json_array(items.limit(0), ["value"], str(tmp_path / "none.json"), value="item")
    sinks.write_csv_document(rec.limit(0), ["value"], str(tmp_path / "none.csv"))
    assert (tmp_path / "none.json").read_text() == "[]" and (tmp_path / "none.csv").read_text() == ""


def test_failed_documents_leave_nothing(spark, tmp_path):
    rows = spark.range(5_000).select("id", F.when(F.col("id") != 4_000, F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="INVALID_INPUT"):
        sinks.write_json_array(rows, ["id"], str(tmp_path / "a.json"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Refused):
        ranges.csv_rows(spark, str(tmp_path), sep='"')
