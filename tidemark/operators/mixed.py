"""Record programs on records whose fields differ in type from row to row: ``rec`` is a map of field names to JSON texts.

A field that is absent has no entry, one that is null has the text ``null``, and the two stay apart. Values of all types have
one order: absent, null, booleans, numbers, texts, arrays, objects; within a type by value, arrays and objects by their
canonical text. As a struct (class, number, text) it is a sort key that Spark compares, partitions by range and keeps through
steps that change the field; rows only move at the end or for a limit. ``records.validate`` and ``schema_of`` hold here too.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.coerce import json_string, text_to_number
from ..functions.text import bound, json_number_text, trim_all
from .records import POS, _sorted_by, dense, validate

REC = "rec"
ABSENT, NULL, BOOLEAN, NUMBER, TEXT, ARRAY, OBJECT = range(-1, 6)
_NAMES = {NULL: "null", BOOLEAN: "a boolean", NUMBER: "a number", TEXT: "a text", ARRAY: "an array", OBJECT: "an object"}
_INTEGER = r"^-?[0-9]+$"


def kind(v: Column) -> Column:
    """The class of a JSON text; -1 where there is none."""
    first = F.substring(v, 1, 1)
    return (
        F.when(v.isNull(), ABSENT).when(first == "n", NULL).when(first.isin("t", "f"), BOOLEAN).when(first == '"', TEXT).when(first == "[", ARRAY).when(first == "{", OBJECT).otherwise(NUMBER)
    )


def text_of(v: Column) -> Column:
    """The text that a JSON string says."""
    return F.try_variant_get(F.try_parse_json(v), "$", "string")


def canonical(v: Column) -> Column:
    """An array or object without white space, keys in order."""
    return F.to_json(F.try_parse_json(v))


def sort_key(v: Column) -> Column:
    """What orders values of any type."""
    number = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    return bound(kind(v), lambda k: F.struct(k.alias("class"), F.when(k.isin(BOOLEAN, NUMBER), number).alias("number"), F.when(k == TEXT, text_of(v)).when(k >= ARRAY, canonical(v)).alias("text")))


def _identity(v: Column) -> Column:
    """Equal for equal values only; whole numbers and fractions are never equal."""
    number = F.when(v.rlike(_INTEGER), v.try_cast("decimal(38,0)").cast("string")).otherwise(F.concat(F.lit("f"), (v.try_cast("double") + 0.0).cast("string")))
    return bound(kind(v), lambda k: F.concat(k.cast("string"), F.lit(":"), F.when(k == NUMBER, F.coalesce(number, v)).when(k == TEXT, text_of(v)).when(k >= ARRAY, canonical(v)).otherwise(v)))


def _refuse(what: str, v: Column, kind_: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"NOT_APPLICABLE: {what} takes no "), v)).cast(kind_)


def _shown(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _test(s: dict) -> Column:
    v, test = F.try_element_at(REC, F.lit(s["field"])), s["predicate"]
    if test in ("exists", "not_exists"):
        return v.isNotNull() if test == "exists" else v.isNull()
    value = s["value"]
    other = F.lit(_shown(value))
    if test in ("eq", "ne"):
        same = _identity(v) == _identity(other)
        return v.isNotNull() & (same if test == "eq" else ~same)
    k = kind(v)
    if test == "contains":
        listed = F.transform(F.try_variant_get(F.try_parse_json(v), "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
        has = F.exists(listed, lambda x: _identity(x) == _identity(canonical(other)))
        text = F.contains(text_of(v), F.lit(value)) if isinstance(value, str) else _refuse("contains", v, "boolean")
        return F.when(v.isNull(), False).when(k == TEXT, text).when(k == ARRAY, has).otherwise(_refuse("contains", v, "boolean"))
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if not number and not isinstance(value, str):
        raise Refused("NOT_APPLICABLE", f"{test} compares numbers or texts", s["field"])
    a, b = (v.try_cast("double"), F.lit(float(value))) if number else (text_of(v), F.lit(value))
    met = {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b}[test]
    return F.when(v.isNull(), False).when(k == (NUMBER if number else TEXT), met).otherwise(_refuse(test, v, "boolean"))


def _mapped(v: Column, how: str) -> Column:
    """JSON text of a mapped value; v is there."""
    k = kind(v)
    if how == "to_string":
        number = F.when(v.rlike(_INTEGER), v).otherwise(json_number_text(v.try_cast("double")))
        return F.when(k == TEXT, v).otherwise(json_string(F.when(k == NUMBER, number).when(k >= ARRAY, canonical(v)).otherwise(v)))
    text = text_of(v)
    if how == "to_number":
        read = bound(trim_all(text), lambda t: F.when(text_to_number(t).isNotNull(), json_number_text(t.try_cast("double"))))
        return F.when(k == NUMBER, v).when((k == TEXT) & read.isNotNull(), read).otherwise(_refuse(how, v, "string"))
    return F.when(k == TEXT, json_string({"lowercase": F.lower, "uppercase": F.upper, "trim": trim_all}[how](text))).otherwise(_refuse(how, v, "string"))


def _apply(df: DataFrame, program: Any, key: str) -> tuple[DataFrame, list[tuple[str, bool]]]:
    df = df.select(REC, F.col(key).alias("__order"))
    order, rec = [("__order", False)], F.col(REC)
    without = lambda m, *names: F.map_filter(m, lambda k, _: ~k.isin(*names)) if names else m
    for i, s in enumerate(validate(program)):
        op = s["op"]
        if op == "select_fields":
            df = df.withColumn(REC, _kept(rec, s["fields"]))
        elif op == "drop_fields":
            df = df.withColumn(REC, without(rec, *s["fields"]))
        elif op == "rename_field":
            if s["from"] == s["to"]:
                raise Refused("NOT_APPLICABLE", "a field is renamed to another name", "to")
            moved = F.map_concat(without(rec, s["from"], s["to"]), F.create_map(F.lit(s["to"]), F.element_at(rec, F.lit(s["from"]))))
            df = df.withColumn(REC, F.when(F.map_contains_key(rec, s["from"]), moved).otherwise(rec))
        elif op == "set_field":
            df = df.withColumn(REC, F.map_concat(without(rec, s["field"]), F.create_map(F.lit(s["field"]), F.lit(_shown(s["value"])))))
        elif op == "filter":
            df = df.where(_test(s))
        elif op == "map_field":
            new = F.map_concat(without(rec, s["field"]), F.create_map(F.lit(s["field"]), _mapped(F.element_at(rec, F.lit(s["field"])), s["transform"])))
            df = df.withColumn(REC, F.when(F.map_contains_key(rec, s["field"]), new).otherwise(rec))
        elif op == "sort_by":
            df = df.withColumn(f"__key{i}", sort_key(F.try_element_at(rec, F.lit(s["field"]))))
            order = [(f"__key{i}", s["order"] == "desc"), *order]
        elif op == "limit":
            df = df.orderBy(*_sorted_by(order)).limit(s["n"])
        else:
            order = [(c, not down) for c, down in order]
    return df, order


def _kept(rec: Column, fields: list[str]) -> Column:
    return F.map_filter(rec, lambda k, _: k.isin(*fields))


def run(df: DataFrame, program: Any, order: str = POS) -> DataFrame:
    """(rec, pos): the records of ``df`` after the program's steps; ``order`` is the column that orders them before, the struct
    ``pos`` of a number ``n`` does after. What a step can't do with a value's type refuses, as does a comparison of two types;
    absent fields are skipped, and meet no comparison."""
    out, by = _apply(df, program, order)
    return dense(out, _sorted_by(by)).select(REC, POS)


def rows(df: DataFrame, program: Any, order: str = POS) -> DataFrame:
    """(rec) in order."""
    out, by = _apply(df, program, order)
    return out.orderBy(*_sorted_by(by)).select(REC)
