"""What a text file holds, by extension and content: format names, most specific first, with ``;list`` and ``;record`` marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kinds(name: str, *marks: str) -> Column:
    return F.array(*(F.lit(name + m) for m in (*marks, "")))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _json(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when(t.startswith("{"), _kinds("json", ";record"))
        .when(t.rlike(r"(?U)^\[\s*\{"), _kinds("json", ";list;record", ";list"))
        .when(t.startswith("["), _kinds("json", ";list"))
        .otherwise(_kinds("json"))
    )


def _ndjson(text: Column) -> Column:
    record = F.exists(F.slice(_lines(text), 1, 10), lambda x: x.rlike(r"(?U)^\s*\{"))
    return F.when(record, _kinds("ndjson", ";list;record", ";list")).otherwise(_kinds("ndjson", ";list"))


def _yaml(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    starts = F.size(F.split(text, "\n---")) - 1 + F.when(t.startswith("---"), 1).otherwise(0)
    first = F.regexp_replace(F.split(F.regexp_replace(t, r"\A---", ""), "\n---")[0], r"(?U)^\s+", "")
    mapping = lambda c: c.rlike(r"(?m)^\s*[^#\s:-][^:\n]*:(\s|$)")
    item = F.regexp_extract(first, r"(?m)^\s*-[ \t]*(.*)$", 1)
    both, some, plain = _kinds("yaml", ";list;record", ";list"), _kinds("yaml", ";list"), _kinds("yaml")
    return (
        F.when((starts > 1) & mapping(first), both)
        .when(starts > 1, some)
        .when(first == "", plain)
        .when(first.startswith("-") & item.contains(":"), both)
        .when(first.startswith("-"), some)
        .when(first.startswith("{"), _kinds("yaml", ";record"))
        .when(first.startswith("[") & first.contains("{"), both)
        .when(first.startswith("["), some)
        .when(first.contains(":"), _kinds("yaml", ";record"))
        .otherwise(plain)
    )


def _xml(text: Column) -> Column:
    body = F.regexp_replace(text, r"(?s)\A.*?\?>", "")
    letter = F.regexp_extract(body, r"<([A-Za-z])", 1)
    repeats = F.when(letter != "", F.size(F.split(body, F.concat(F.lit("<"), letter))) - 1).otherwise(0)
    record = body.contains("=") | (F.size(F.split(body, "<")) - 1 > 2)
    return F.when(repeats > 2, _kinds("xml", ";list;record", ";list")).when(record, _kinds("xml", ";record")).otherwise(_kinds("xml"))


def detect(text: Column, extension: Column) -> Column:
    """Array of kinds; empty for an unknown extension or a null text."""
    e = F.lower(extension)
    table = lambda name: F.array(F.lit(f"{name};list;record"))
    out = (
        F.when(e == "json", _json(text)).when(e.isin("ndjson", "jsonl"), _ndjson(text)).when(e.isin("yaml", "yml"), _yaml(text)).when(e == "xml", _xml(text))
        .when(e == "csv", table("csv")).when(e == "tsv", table("tsv")).when(e == "psv", table("psv")).when(e == "toml", _kinds("toml"))
    )
    return F.coalesce(F.when(text.isNotNull(), out), F.array().cast("array<string>"))
