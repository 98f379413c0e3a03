"""Record programs on DataFrames: a list of steps becomes one declarative plan, which Catalyst then prunes and pushes down.

A step is a dict with ``op`` and its arguments. Order is data here: a table is given its order by ``numbered``, which adds
``pos``, or ``pos_`` and so on where a field has that name. Sorting is stable by it: a sort puts its field in front of the order and a reversal turns the order round, so
neither moves a row; rows are only sorted where a step needs it (limit) or at the end. Dense numbers come from range
partitions and their sizes, not from one global window.
Absent and null fields are the same thing in a table; ``mixed`` runs programs on records whose fields differ in type from row
to row. Fields are told apart by case; tables that hold names which differ in case only need spark.sql.caseSensitive.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused, whole
from ..functions.text import json_number_text, trim_all
from ..scratch import held

POS = "pos"
_MARK = "tidemark_order"
OPS = {
    "select_fields": ("fields",), "drop_fields": ("fields",), "rename_field": ("from", "to"), "set_field": ("field", "value"), "filter": ("field", "predicate"),
    "map_field": ("field", "transform"), "sort_by": ("field", "order"), "limit": ("n",), "reverse": (),
}
TESTS = ("eq", "ne", "gt", "lt", "ge", "le", "contains", "exists", "not_exists")
MAPS = ("lowercase", "uppercase", "trim", "to_string", "to_number")


def _free(name: str, taken) -> str:
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def col(name: str) -> Column:
    """The field of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _as_key(c: Column, name: str) -> Column:
    return c.alias(name, metadata={_MARK: True})


def key_of(df: DataFrame) -> str:
    """The column that holds the order."""
    marked = [f.name for f in df.schema.fields if f.metadata and f.metadata.get(_MARK)]
    if not marked and POS not in df.columns:
        raise Refused("INVALID_INPUT", "the table has no order: use numbered", "records")
    return marked[0] if marked else POS


def fields_of(df: DataFrame) -> list[str]:
    key = key_of(df)
    return [c for c in df.columns if c != key]


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with a key that orders rows (the given columns), not a dense number, so nothing is shuffled. It is named ``pos``,
    or ``pos_`` and so on where that name is taken; ``key_of`` tells."""
    key = F.struct(*(col(o) if isinstance(o, str) else o for o in order))
    return df.select(*map(col, df.columns), _as_key(key, _free(POS, df.columns)))


def validate(program: Any, fields: list[str] | None = None) -> list[dict]:
    """The steps, or NOT_A_PROGRAM. With ``fields``, steps that read a field may name only those and ones set before."""
    steps = program.get("ops") if isinstance(program, dict) else program
    if not isinstance(steps, list) or not steps:
        raise Refused("NOT_A_PROGRAM", "a program is a list of one step or more", "program")
    known = set(fields or ())
    for i, s in enumerate(steps):
        op = s.get("op") if isinstance(s, dict) else None
        if op not in OPS or any(a not in s for a in OPS[op]):
            raise Refused("NOT_A_PROGRAM", f"step {i}: {s!r}", "program")
        if extra := set(s) - {"op", *OPS[op]} - ({"value"} if op == "filter" else set()):
            raise Refused("NOT_A_PROGRAM", f"step {i}: {op} takes no {sorted(extra)[0]!r}", "program")
        if op == "filter" and (s["predicate"] not in TESTS or ((s.get("value") is None) != (s["predicate"] in ("exists", "not_exists")))):
            raise Refused("NOT_A_PROGRAM", f"step {i}: comparisons take a value, existence none", "program")
        if op == "map_field" and s["transform"] not in MAPS or op == "sort_by" and s["order"] not in ("asc", "desc"):
            raise Refused("NOT_A_PROGRAM", f"step {i}: {s!r}", "program")
        if op == "limit" and (isinstance(s["n"], bool) or not isinstance(s["n"], int) or s["n"] < 0):
            raise Refused("NOT_A_PROGRAM", f"step {i}: limit takes a whole number", "program")
        read = s["fields"] if op in ("select_fields", "drop_fields") else [s.get("from") or s.get("field")] if op not in ("set_field", "limit", "reverse") else []
        if fields is not None and (lost := [f for f in read if f not in known]):
            raise Refused("NOT_A_PROGRAM", f"step {i}: no field {lost[0]!r}", "program")
        known |= {s.get("to"), s.get("field")} - {None}
    return steps


def schema_of(fields: list[str]) -> dict:
    """The JSON schema of programs over ``fields``: what reads a field may name only these (any, if there are none)."""
    name: dict = {"type": "string"}
    read = name | ({"enum": sorted(fields)} if fields else {})
    kinds = {
        "fields": {"type": "array", "items": read}, "from": read, "to": name, "value": {}, "predicate": {"enum": list(TESTS)}, "transform": {"enum": list(MAPS)}, "order": {"enum": ["asc", "desc"]}, "n": {"type": "integer", "minimum": 0},
    }
    steps = []
    for op, args in OPS.items():
        props = {"op": {"const": op}} | {a: kinds.get(a, name if op == "set_field" else read) for a in args}
        steps.append({"type": "object", "properties": props | ({"value": {}} if op == "filter" else {}), "required": ["op", *args]})
    return {"type": "object", "properties": {"ops": {"type": "array", "minItems": 1, "maxItems": 32, "items": {"anyOf": steps}}}, "required": ["ops"]}


def _lit(value: Any) -> Column:
    if isinstance(value, list | dict):
        import json

        return F.parse_json(F.lit(json.dumps(value)))
    return F.lit(value)


def json_type(t: T.DataType) -> str:
    """The JSON name of a column's type."""
    if isinstance(t, T.StructType | T.MapType):
        return "object"
    return "array" if isinstance(t, T.ArrayType) else "boolean" if isinstance(t, T.BooleanType) else "number" if _numeric(t) else "string"


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _test(df: DataFrame, s: dict) -> Column:
    c, test, value = col(s["field"]), s["predicate"], s.get("value")
    kind = df.schema[s["field"]].dataType
    if test == "exists":
        return c.isNotNull()
    if test == "not_exists":
        return c.isNull()
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if test == "contains":
        if isinstance(kind, T.StringType) and isinstance(value, str):
            return c.contains(value)
        if isinstance(kind, T.ArrayType):
            return F.array_contains(c, value)
        raise Refused("NOT_APPLICABLE", f"contains on {s['field']}: {kind.simpleString()}", s["field"])
    same = (_numeric(kind) and number) or (isinstance(kind, T.StringType) and isinstance(value, str)) or (isinstance(kind, T.BooleanType) and isinstance(value, bool))
    if test in ("eq", "ne"):
        if isinstance(kind, T.IntegralType) and isinstance(value, float) or isinstance(kind, T.FractionalType) and isinstance(value, int):
            same = False  # 1 and 1.0 are different values
        equal = (c == F.lit(value)) if same else F.lit(False)
        return c.isNotNull() & (equal if test == "eq" else ~equal)
    if not same or isinstance(value, bool):
        raise Refused("NOT_APPLICABLE", f"{test} compares numbers or texts; {s['field']} is {kind.simpleString()}", s["field"])
    return {"gt": c > value, "lt": c < value, "ge": c >= value, "le": c <= value}[test]


def _mapped(df: DataFrame, field: str, how: str) -> Column:
    c, kind = col(field), df.schema[field].dataType
    text = isinstance(kind, T.StringType)
    if how in ("lowercase", "uppercase", "trim") and not text:
        raise Refused("NOT_APPLICABLE", f"{how} takes text; {field} is {kind.simpleString()}", field)
    if how == "to_string":
        shown = c if text else json_number_text(c) if isinstance(kind, T.DoubleType | T.FloatType) else F.to_json(c) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else c.cast("string")
        return F.coalesce(shown, F.lit("null"))
    if how == "to_number":
        if _numeric(kind):
            return c
        if not text:
            raise Refused("NOT_APPLICABLE", f"to_number takes text or numbers; {field} is {kind.simpleString()}", field)
        t = trim_all(c)
        number = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
        number = F.when(F.abs(number) < float("inf"), number)
        return F.when(c.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("NOT_APPLICABLE: not a number: "), c)).cast("double")).otherwise(number)
    return {"lowercase": F.lower(c), "uppercase": F.upper(c), "trim": trim_all(c)}[how]


Order = list[tuple[str, bool]]  # columns, the first one leading, and whether they descend


def _sorted_by(order: Order) -> list[Column]:
    return [col(c).desc_nulls_last() if down else col(c).asc_nulls_first() for c, down in order]


def _planned(df: DataFrame, program: Any) -> tuple[DataFrame, Order]:
    """The program's rows and their order, whose keys are columns of their own: steps that follow may change a field."""
    steps, key = validate(program), key_of(df)
    named = {x for s in steps for v in s.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)} | set(df.columns)
    own = lambda i: _free(f"__order{i}", named)
    df = df.select(*map(col, fields_of(df)), col(key).alias(own("")))
    order: Order = [(own(""), False)]
    put = lambda df, name, c: df.select(*(col(x) for x in df.columns if x != name and x not in keys), c.alias(name), *map(col, keys)) if name not in df.columns else df.select(*(c.alias(name) if x == name else col(x) for x in df.columns))
    for i, s in enumerate(steps):
        op, keys = s["op"], [c for c, _ in order]
        if op == "select_fields":
            df = df.select(*[col(c) for c in dict.fromkeys(s["fields"]) if c in df.columns], *map(col, keys))
        elif op == "drop_fields":
            df = df.select(*[col(c) for c in df.columns if c not in s["fields"]])
        elif op == "rename_field":
            if s["from"] == s["to"]:
                raise Refused("NOT_APPLICABLE", "a field is renamed to another name", "to")
            if s["from"] in df.columns:
                df = df.select(*[col(c).alias(s["to"]) if c == s["from"] else col(c) for c in df.columns if c != s["to"]])
        elif op == "set_field":
            df = put(df, s["field"], _lit(s["value"]))
        elif op == "filter":
            df = df.where(_test(df, s)) if s["field"] in df.columns else df.where(F.lit(s["predicate"] == "not_exists"))
        elif op == "map_field":
            if s["field"] in df.columns:
                df = put(df, s["field"], _mapped(df, s["field"], s["transform"]))
        elif op == "sort_by":
            if s["field"] in df.columns:
                df = df.select(*map(col, df.columns), col(s["field"]).alias(own(i)))
                order = [(own(i), s["order"] == "desc"), *order]
        elif op == "limit":
            df = df.orderBy(*_sorted_by(order)).limit(s["n"])
        else:
            order = [(c, not down) for c, down in order]
    return df, order


def run(df: DataFrame, program: Any) -> DataFrame:
    """``df`` (see ``numbered``) after the program's steps, with a new key where they reorder. Fields that a step names and the
    table lacks: kept lists and drops skip them, renames do nothing, filters match nothing (``not_exists``: everything), sorts
    and maps do nothing."""
    out, order = _planned(df, program)
    keys = [c for c, _ in order]
    fields = [c for c in out.columns if c not in keys]
    name = _free(POS, fields)
    if order == [(keys[0], False)]:
        return out.select(*map(col, fields), _as_key(col(keys[0]), name))
    return dense(out, _sorted_by(order), name).select(*map(col, fields), col(name))


def rows(df: DataFrame, program: Any) -> DataFrame:
    """The program's rows in order, without the key: one sort at the end at most."""
    out, order = _planned(df, program)
    keys = {c for c, _ in order}
    return out.orderBy(*_sorted_by(order)).select(*[col(c) for c in out.columns if c not in keys])


def dense(df: DataFrame, order: list[Column], name: str = POS) -> DataFrame:
    """``df`` with the key ``name`` (a struct of ``n``) as dense numbers from 0 in the given order. Rows are sorted by range, one shuffle, and written with
    their place: partition and row. Numbers follow from the sizes of those very partitions, so no task sees all rows."""
    place = F.monotonically_increasing_id()
    kept = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "ranged")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(part.alias("__p")).agg(F.count("*").alias("c")).select("__p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__s"))
    numbered = kept.withColumn("__p", part).join(F.broadcast(starts), "__p")  # one row per partition
    place = F.struct((F.col("__s") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("n"))
    return numbered.select(*(col(c) for c in df.columns if c != name), _as_key(place, name))


def every_nth(df: DataFrame, stride: int = 1) -> DataFrame:
    """Rows 0, stride, 2 x stride, ... in order."""
    whole(stride, "stride")
    key = key_of(df)
    return dense(df, [col(key)], key).where(col(key)["n"] % stride == 0)
