"""Inputs that once gave wrong results without a word."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records, series
from tidemark.sources import repair


def shown(spark, df, program):
    out = records.run(records.numbered(df, "id"), program)
    key = records.key_of(out)
    return [{k: v for k, v in r.asDict().items() if k != key} for r in out.orderBy(F.col(f"`{key}`")).collect()]


def test_fields_named_like_keys(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 4), (3, "z", 6)], "id int, a string, pos int")
    assert shown(spark, df, [{"op": "rename_field", "from": "a", "to": "pos"}]) == [{"id": 1, "pos": "x"}, {"id": 2, "pos": "y"}, {"id": 3, "pos": "z"}]
    assert shown(spark, df, [{"op": "set_field", "field": "pos", "value": 0}, {"op": "reverse"}]) == [{"id": i, "a": a, "pos": 0} for i, a in ((3, "z"), (2, "y"), (1, "x"))]
    assert shown(spark, df, [{"op": "sort_by", "field": "pos", "order": "asc"}, {"op": "drop_fields", "fields": ["pos"]}]) == [{"id": 2, "a": "y"}, {"id": 1, "a": "x"}, {"id": 3, "a": "z"}]
    assert shown(spark, df.drop("pos"), [{"op": "set_field", "field": "pos", "value": "p"}, {"op": "set_field", "field": "__order", "value": 1}, {"op": "limit", "n": 1}]) == [{"id": 1, "a": "x", "pos": "p", "__order": 1}]
    assert [r.id for r in records.every_nth(records.numbered(df, "id"), 2).collect()] == [1, 3]
    assert [r.pos for r in records.rows(records.numbered(df, "id"), [{"op": "reverse"}]).collect()] == [6, 4, 5]


def test_fields_with_dots_and_case(spark):
    df = spark.createDataFrame([(2, 1.0, "q"), (1, 2.5, "p")], ["id", "a.b", "c`d"])
    steps = [
        {"op": "filter", "field": "a.b", "predicate": "gt", "value": 0.5}, {"op": "sort_by", "field": "a.b", "order": "desc"}, {"op": "map_field", "field": "c`d", "transform": "uppercase"},
        {"op": "map_field", "field": "a.b", "transform": "to_string"}, {"op": "select_fields", "fields": ["c`d", "a.b", "none"]},
    ]
    assert shown(spark, df, steps) == [{"c`d": "P", "a.b": "2.5"}, {"c`d": "Q", "a.b": "1.0"}]
    one = spark.createDataFrame([(1, "x")], "id int, a string")
    assert shown(spark, one, [{"op": "drop_fields", "fields": ["A"]}]) == [{"id": 1, "a": "x"}]
    assert shown(spark, one, [{"op": "rename_field", "from": "A", "to": "b"}]) == [{"id": 1, "a": "x"}]


def test_numbers_as_json_text(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1e16), (3, -0.5), (4, 1e-7), (5, None)], "id int, v double")
    assert [r["v"] for r in shown(spark, df, [{"op": "map_field", "field": "v", "transform": "to_string"}])] == ["2.0", "1e16", "-0.5", "1e-7", "null"]


@pytest.mark.parametrize(
    "step",
    [
        lambda a, b: series.align(a, b), lambda a, b: series.align(b, a), lambda a, b: series.combine(a, a, "add"), lambda a, b: series.combine(b, a, "add"), lambda a, b: series.correlate(a, b),
        lambda a, b: series.resample(a, "daily"), lambda a, b: series.summarize(a, "count"), lambda a, b: series.describe(a), lambda a, b: series.change(a), lambda a, b: series.lag(a, 1),
    ],
)
def test_repeated_instants(spark, step):
    day = lambda i: dt.datetime(2030, 1, i)
    schema = "series_id string, time timestamp, value double"
    a = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), 2.0), ("a", day(2), 5.0), ("a", day(3), 2.5), ("b", day(2), 3.0)], schema)
    b = spark.createDataFrame([(k, day(i), i * i * 1.0) for k in "ab" for i in range(1, 5)], schema)
    with pytest.raises(Exception, match="NOT_A_SERIES"):
        step(a, b).collect()


def test_stray_commas_and_escapes():
    for text, want, notes in [
        ("[1,,2]", [1, 2], 1), ('{"a":1,,"b":2}', {"a": 1, "b": 2}, 1), ("[,1]", [1], 1), ("[1,]", [1], 1), ("[1,,]", [1], 1), ("[,]", [], 1), ('"\\\'"', "'", 1), ("[.5]", [0.5], 1), ("[1, 2]", [1, 2], 0),
        ('{,"a":[1 2],}', {"a": [1, 2]}, 3),
    ]:
        got, repairs, error = repair.repaired(text)
        assert error is None and json.loads(got) == want and len(repairs) == notes, text
    assert repair.repaired("[.]")[0] is None


def test_any_text_is_json_or_refused():
    """Output always parses; notes stand exactly where a strict reader fails."""
    r = random.Random(8)
    strict = lambda t: json.loads(t, parse_constant=lambda c: 1 / 0)
    for _ in range(60_000):
        text = "".join(r.choices('[]{},:"\'\\/ \n\t019.-+eEtrufalsn*é', k=r.randint(1, 14)))
        got, repairs, error = repair.repaired(text)
        try:
            value, sound = strict(text), True
        except (ValueError, ZeroDivisionError):
            sound = False
        if error is None:
            again = json.loads(got)
            assert sound <= (again == value if sound else True), text
            if not sound:
                assert repairs, text
            elif repairs:  # a key twice is JSON, and noted all the same
                assert {x["what"] for x in repairs} == {"a later value of the same key taken"}, text
        else:
            assert got is None and not repairs
            assert not sound or "large" in error or "nested" in error, text
