"""Programs on records of mixed types against a plain definition."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mixed
from tidemark.sources import convert

VALUES = [None, True, False, 0, 1, -3, 10**15, 1.0, 2.5, -0.5, 1e20, "", "a", "b", "é", "Z", " x ", "10", "null", [], [1], [1, 2], ["a"], [None, {"k": 1}], {}, {"k": 1}, {"a": [1, "x"]}, "a\"b\n"]
_GAP = object()


def compact(v):
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def order(v):
    if v is _GAP:
        return (-1,)
    for i, kinds in enumerate([type(None), bool, int | float, str, list, dict]):
        if isinstance(v, kinds):
            return (i, () if v is None else v if isinstance(v, bool | int | float) else v.encode() if isinstance(v, str) else compact(v).encode())


def table(spark, values):
    rows = [(i, {"id": compact(i)} | ({} if v is _GAP else {"v": compact(v)})) for i, v in enumerate(values)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "n int, rec map<string,string>").repartition(3)


def got(df):
    return [{k: json.loads(v) for k, v in r.rec.items()} for r in df.collect()]


def test_order(spark):
    values = [random.Random(2).choice([*VALUES, _GAP]) for _ in range(400)]
    for down in (False, True):
        ranked = sorted(range(len(values)), key=lambda i: order(values[i]), reverse=down)
        if down:  # ties keep their order
            ranked = [i for _, i in sorted(((-sorted({order(v) for v in values}).index(order(values[i])), i) for i in range(len(values))))]
        steps = [{"op": "sort_by", "field": "v", "order": "desc" if down else "asc"}]
        assert [x["id"] for x in got(mixed.rows(table(spark, values), steps, "n"))] == ranked
        out = mixed.run(table(spark, values), steps, "n").select(F.col("rec")["id"].cast("int"), "pos.n").collect()
        assert [i for i, _ in sorted(out, key=lambda x: x[1])] == ranked
        assert [x["id"] for x in got(mixed.rows(table(spark, values), [*steps, {"op": "reverse"}, {"op": "limit", "n": 7}], "n"))] == ranked[::-1][:7]


@pytest.mark.parametrize("value", [None, True, 1, 1.0, 2.5, "a", "null", [1], {"k": 1}])
def test_equal(spark, value):
    values = [*VALUES, _GAP]
    same = lambda v: type(v) is type(value) and v == value
    for test in ("eq", "ne"):
        if value is None:
            continue
        want = [i for i, v in enumerate(values) if v is not _GAP and same(v) == (test == "eq")]
        assert [x["id"] for x in got(mixed.rows(table(spark, values), [{"op": "filter", "field": "v", "predicate": test, "value": value}], "n"))] == want


def test_there(spark):
    values = [None, _GAP, 1, _GAP]
    ids = lambda test: [x["id"] for x in got(mixed.rows(table(spark, values), [{"op": "filter", "field": "v", "predicate": test}], "n"))]
    assert ids("exists") == [0, 2] and ids("not_exists") == [1, 3]


def test_compare_and_contain(spark):
    rows = lambda values, test, value: [x["v"] for x in got(mixed.rows(table(spark, values), [{"op": "filter", "field": "v", "predicate": test, "value": value}], "n"))]
    assert rows([1, 2.5, _GAP, -3], "ge", 1) == [1, 2.5]
    assert rows(["a", "é", "Z"], "gt", "Z") == ["a", "é"]
    assert rows(["xay", ["a"], ["b", "a"], [["a"]], _GAP, []], "contains", "a") == ["xay", ["a"], ["b", "a"]]
    assert rows([[1, {"k": [2]}], [{"k": 2}]], "contains", {"k": [2]}) == [[1, {"k": [2]}]]
    for values, test, value in ([[1, "a"], "lt", 2], [[None], "lt", 2], [[1], "contains", "a"]):
        with pytest.raises(Exception, match="NOT_APPLICABLE"):
            rows(values, test, value)


def test_maps(spark):
    mapped = lambda values, how: [x.get("v", _GAP) for x in got(mixed.rows(table(spark, values), [{"op": "map_field", "field": "v", "transform": how}], "n"))]
    shown = lambda v: v if v is _GAP or isinstance(v, str) else "1e20" if v == 1e20 and isinstance(v, float) else compact(v)
    assert mapped([*VALUES, _GAP], "to_string") == [shown(v) for v in [*VALUES, _GAP]]
    assert mapped([" 12 ", "1e3", 7, 2.5, _GAP], "to_number") == [12.0, 1000.0, 7, 2.5, _GAP]
    assert mapped([" ÀB "], "lowercase") == [" àb "] and mapped([" x　"], "trim") == ["x"]
    for v, how in ((1, "trim"), ("x", "to_number"), (None, "to_number"), ([], "lowercase")):
        with pytest.raises(Exception, match="NOT_APPLICABLE"):
            mapped([v], how)


def test_fields(spark):
    rows = [(0, {"a": "1", "b": "null"}), (1, {"b": '"x"', "a.c": "[]"}), (2, {})]
    df = spark.createDataFrame(rows, "n int, rec map<string,string>")
    after = lambda *steps: [r.rec for r in mixed.rows(df, list(steps), "n").collect()]
    assert after({"op": "rename_field", "from": "a", "to": "b"}) == [{"b": "1"}, {"b": '"x"', "a.c": "[]"}, {}]
    assert after({"op": "set_field", "field": "b", "value": {"k": [1, None]}}) == [{"a": "1", "b": '{"k":[1,null]}'}, {"a.c": "[]", "b": '{"k":[1,null]}'}, {"b": '{"k":[1,null]}'}]
    assert after({"op": "select_fields", "fields": ["a.c", "a"]}) == [{"a": "1"}, {"a.c": "[]"}, {}]
    assert after({"op": "drop_fields", "fields": ["b"]}, {"op": "reverse"}) == [{}, {"a.c": "[]"}, {"a": "1"}]
    read = spark.createDataFrame([(0, '{"a": [1, 2], "b": null}')], "n int, t string").select("n", convert.json_fields(F.col("t")).alias("rec"))
    assert mixed.rows(read, [{"op": "sort_by", "field": "b", "order": "asc"}], "n").first().rec == {"a": "[1,2]", "b": "null"}
