"""Conversion between CSV, JSON, YAML and text lists.

Records are ordinary rows. Files are read and written by Spark's own sources, split by Spark; documents in a column are taken
apart and put together by expressions. Only YAML, for which Spark has no functions, goes through small Arrow functions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import Refused
from ..functions.coerce import infer_csv
from ..functions.text import is_json
from .ranges import csv_records, csv_rows, json_elements

try:
    import yaml
except ImportError:  # YAML conversions refuse then
    yaml = None

BOM = "﻿"


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(rec map<string, string>): each field as JSON text, inferred losslessly field by field. Large files are read by many
    tasks, several each under its own header; ragged rows fail. ``ranges.csv_records`` has the rows' places too."""
    return csv_records(spark, path, sep).select("rec")


def typed_fields(df: DataFrame) -> DataFrame:
    pairs = [x for c in df.columns for x in (F.lit(c.removeprefix(BOM)), infer_csv(F.col(f"`{c}`").cast("string")))]
    return df.select(F.create_map(*pairs).alias("rec"))


def to_json_text(rec: Column) -> Column:
    """A JSON object of a map of JSON texts, keys in order."""
    keys = F.array_sort(F.map_keys(rec))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), rec[k])), ","), F.lit("}"))


def json_fields(obj: Column) -> Column:
    """Map of a JSON object's fields as JSON texts; null for anything else. Nested values stay as they are written."""
    v = F.try_parse_json(obj)
    return F.when(is_json(obj) & F.schema_of_variant(v).startswith("OBJECT"), F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.coalesce(F.to_json(x), F.lit("null"))))


def read_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """(rec map<string, string>) of a file of one object per line, or of one array (``array``), which many tasks read."""
    lines = json_elements(spark, path) if array else spark.read.text(path)
    return lines.select(json_fields(F.col("value")).alias("rec"))


def text_of_json(value: Column) -> Column:
    """A field for CSV or a text list: strings bare, null empty, others as JSON."""
    v = F.try_parse_json(value)
    return F.when(value == "null", "").when(value.startswith('"'), F.try_variant_get(v, "$", "string")).otherwise(value)


def header(records: DataFrame) -> list[str]:
    """The union of field names, sorted: one row per distinct name reaches the driver."""
    return [r[0] for r in records.select(F.explode(F.map_keys("rec")).alias("k")).distinct().orderBy("k").collect()]


def to_table(records: DataFrame, null: str = "") -> DataFrame:
    """One text column per field of any record; ``null`` stands for nulls, absent fields are empty."""
    get = lambda k: F.try_element_at("rec", F.lit(k))
    return records.select(*(F.coalesce(F.when(get(k) == "null", null).otherwise(text_of_json(get(k))), F.lit("")).alias(k) for k in header(records)))


def write_csv(records: DataFrame, path: str, null: str = "") -> None:
    to_table(records, null).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(records: DataFrame, path: str) -> None:
    records.select(to_json_text(F.col("rec"))).write.text(path)


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line that is not empty."""
    return spark.read.text(path).where("value <> ''")


def list_item(line: Column) -> Column:
    """JSON text of a line: as it is where it is JSON, else as a string."""
    as_text = F.regexp_extract(F.to_json(F.struct(line.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(is_json(line), line).otherwise(as_text)


def lines_of_json(items: Column) -> Column:
    """Array of the lines of a JSON array's text: strings as they are, anything else as its JSON; null if it is no array."""
    listed = F.try_variant_get(F.when(is_json(items), F.try_parse_json(items)), "$", "array<variant>")
    return F.transform(listed, lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v)))


def lines_to_csv(lines: DataFrame, path: str, column: str = "value") -> None:
    """Writes lines as a CSV of one column, named ``value``."""
    lines.select(F.col(column).alias("value")).write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def csv_to_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each row's first field, blank ones too; a byte order mark goes with the header."""
    return csv_rows(spark, path).where("row > 0").select(F.get("fields", 0).alias("value"))


def _need_yaml():
    if yaml is None:
        raise Refused("NOT_DEFINED", "no YAML library is installed", "format")
    return yaml


@F.pandas_udf(StringType())
def json_to_yaml(texts: pd.Series) -> pd.Series:
    dump = _need_yaml().safe_dump
    return texts.map(lambda t: dump(json.loads(t), allow_unicode=True, sort_keys=False), na_action="ignore")


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """Keys become text; what JSON has no form for refuses."""
    load = _need_yaml().safe_load
    return texts.map(lambda t: json.dumps(load(t), ensure_ascii=False, allow_nan=False, default=str), na_action="ignore")


def collect_tables(*tables: DataFrame) -> DataFrame:
    """Many tables as one, fields by name, absent ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def collect_array(items: DataFrame, item: str, pos: str, *by: str) -> DataFrame:
    """(by..., value): each group's items (JSON texts) as one JSON array in order of ``pos``. A group is one document."""
    held = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("i")))).alias("a"))
    return held.select(*by, F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["i"]), ","), F.lit("]")).alias("value"))


def save_text(df: DataFrame, column: str, path: str) -> None:
    """Writes a column of bytes or text; what is no UTF-8 refuses."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "binary":
        c = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.raise_error(F.lit("NOT_TEXT: the bytes are no UTF-8")))
    df.select(c.alias("value")).write.text(path)
