"""Judgments over text by any model: a provider answers, expressions check the answer.

A provider is a function from a list of requests (prompt, schema as JSON) to a list of JSON replies; it runs once per Arrow
batch on the executors. No model comes with the library. Replies that do not have the asked form, or fail the check that
goes with the judgment, are refused in the ``error`` column rather than passed on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import Refused
from ..functions.text import bounded, grounded, guard_schema, is_json, outline

Provider = Callable[[list[tuple[str, str]]], list[str]]
_ENVELOPE = {"confidence": {"type": "number"}, "reason": {"type": "string"}}
_TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "number": "double", "array": "array<string>"}

#: name -> payload fields with their JSON types
KINDS = {
    "decide": {"result": "integer"}, "same": {"same": "boolean"}, "classify": {"label": "string"}, "score": {"score": "number"},
    "verify": {"pass": "boolean", "violations": "array"}, "route": {"target": "string"}, "normalize": {"canonical": "string"}, "ask": {"answer": "string", "quotes": "array"},
    "explain": {"hypothesis": "string", "evidence": "array", "next_checks": "array"}, "summarize": {"summary": "string"},
}


def schema_for(kind: str) -> dict:
    fields = {n: {"type": t} | ({"items": {"type": "string"}} if t == "array" else {}) for n, t in KINDS[kind].items()} | _ENVELOPE
    return {"type": "object", "properties": fields, "required": sorted(fields)}


def _valid(kind: str, content: Column, allowed: list[str] | None, scale: tuple[int, int] | None) -> Column:
    r = lambda n: F.col(f"r.{n}")
    there = r("confidence").isNotNull() & r("reason").isNotNull()
    for n in KINDS[kind]:
        there &= r(n).isNotNull()
    tests = {
        "decide": lambda: r("result").isin(0, 1), "classify": lambda: r("label").isin(*allowed), "route": lambda: r("target").isin(*allowed), "score": lambda: r("score").between(*(scale or (0, 10))),
        "verify": lambda: r("pass") == (F.size(r("violations")) == 0), "ask": lambda: grounded(r("quotes"), content), "explain": lambda: grounded(r("evidence"), content), "summarize": lambda: F.trim(r("summary")) != "",
    }
    return there & tests[kind]() if kind in tests else there


def _asked(df: DataFrame, content: Column, prompt: Column, provider: Provider, form: dict) -> DataFrame:
    """``df`` with ``__reply``: what the provider answered to the prompt and the content, for a JSON of this form."""
    guard_schema(form)
    text = json.dumps(form)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = provider([(p, text) for p in b["__prompt"]])
            if len(replies) != len(b):
                raise ValueError("the provider must give one reply to each request")
            yield b.assign(__reply=replies)

    asked = df.withColumn("__prompt", F.concat(prompt, F.lit("\n\n"), F.coalesce(content, F.lit(""))))
    return asked.mapInPandas(answer, StructType([*asked.schema.fields, StructField("__reply", StringType())])).drop("__prompt")


def _checked(held: DataFrame, columns: list[str], fits: Column, reply: Column) -> DataFrame:
    fits = F.coalesce(fits, F.lit(False))
    return held.select(*columns, F.when(fits, reply).alias("reply"), F.when(~fits, F.concat(F.lit("INVALID_REPLY: "), F.coalesce("__reply", F.lit("")))).alias("error"))


def judge(df: DataFrame, kind: str, content: str, prompt: Column, provider: Provider, allowed: list[str] | None = None, scale: tuple[int, int] | None = None, most_chars: int | None = None) -> DataFrame:
    """``df`` with ``reply`` (struct of the payload, confidence and reason; null if refused) and ``error``. ``prompt`` is what is
    asked of each row; the content follows it, up to ``most_chars`` if that is given. Quotes must stand in what was shown."""
    if kind not in KINDS:
        raise Refused("NOT_A_CHOICE", f"{kind!r} is no judgment", "kind")
    if kind in ("classify", "route") and not allowed:
        raise Refused("INPUT_REQUIRED", f"{kind} takes what may be answered", "allowed")
    shown = bounded(F.col(content), most_chars)
    form = ", ".join(f"`{n}` {_TYPES[t]}" for n, t in (KINDS[kind] | {"confidence": "number", "reason": "string"}).items())
    held = _asked(df, shown, prompt, provider, schema_for(kind)).withColumn("r", F.from_json("__reply", form))
    return _checked(held, df.columns, _valid(kind, shown, allowed, scale), F.col("r"))


def generate_json(df: DataFrame, content: str, schema: dict, prompt: Column, provider: Provider) -> DataFrame:
    """``df`` with ``reply``: JSON text of the caller's schema (null if what came is no JSON), and ``error``."""
    return _checked(_asked(df, F.col(content), prompt, provider, schema), df.columns, is_json(F.col("__reply")), F.col("__reply"))


def extract(df: DataFrame, content: str, schema: dict, prompt: Column, provider: Provider, most_chars: int | None = None) -> DataFrame:
    """``df`` with ``reply`` (result: JSON text of the caller's schema, confidence, reason) and ``error``."""
    form = {"type": "object", "properties": {"result": schema} | _ENVELOPE, "required": ["confidence", "reason", "result"]}
    held = _asked(df, bounded(F.col(content), most_chars), prompt, provider, form).withColumn("v", F.when(is_json(F.col("__reply")), F.try_parse_json("__reply")))
    at = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    reply = F.struct(F.to_json(at("result", "variant")).alias("result"), at("confidence", "double").alias("confidence"), at("reason", "string").alias("reason"))
    return _checked(held, df.columns, at("result", "variant").isNotNull() & at("confidence", "double").isNotNull() & at("reason", "string").isNotNull(), reply)


def decide_many(df: DataFrame, content: str, questions: list[str], prompt: Column, provider: Provider, threshold: float = 0.7, most_chars: int | None = None) -> DataFrame:
    """A decision record for each question and row, ``df``'s columns before it: title and identifier (the question), value,
    confidence, reason, confidence_below_threshold and error. All of a row's questions are asked at once; a reply that
    does not answer each of them with 0 or 1 is refused as a whole, under every question."""
    asked = [q for q in questions if q]
    if not asked:
        raise Refused("INPUT_REQUIRED", "there is no question", "questions")
    item = {"type": "object", "properties": {"res": {"type": "integer"}} | _ENVELOPE, "required": ["confidence", "reason", "res"]}
    form = {"type": "object", "properties": {"res": {"type": "array", "items": item, "minItems": len(asked), "maxItems": len(asked)}}, "required": ["res"]}
    listed = F.concat(prompt, F.lit("\n" + "\n".join(asked)))
    held = _asked(df, bounded(F.col(content), most_chars), listed, provider, form).withColumn("r", F.from_json("__reply", "res array<struct<res:bigint,confidence:double,reason:string>>")["res"])
    whole = (F.size("r") == len(asked)) & F.forall("r", lambda x: x["res"].isin(0, 1) & x["confidence"].isNotNull() & x["reason"].isNotNull())
    each = _checked(held, df.columns, whole, F.col("r")).select("*", F.posexplode(F.array(*map(F.lit, asked))).alias("__i", "title"))
    one = F.get("reply", F.col("__i"))
    return each.select(
        *df.columns, "title", F.col("title").alias("identifier"), (one["res"] == 1).alias("value"), one["confidence"].alias("confidence"), one["reason"].alias("reason"), (one["confidence"] < threshold).alias("confidence_below_threshold"), "error",
    )


def structural_sample(df: DataFrame) -> str:
    """Names and JSON types of the fields of up to three records: all that a model is shown of a table."""
    from ..operators.records import json_type

    kinds = [F.when(F.col(f"`{f.name}`").isNull(), "null").otherwise(json_type(f.dataType)).alias(f.name) for f in df.schema.fields]
    return "\n".join(f"record {i}: {{{', '.join(f'{k}: {v}' for k, v in r.asDict().items())}}}" for i, r in enumerate(df.limit(3).select(*kinds).collect()))


def edit_records(df: DataFrame, instruction: str, provider: Provider) -> tuple[DataFrame, list[dict]]:
    """``df`` (with ``pos``) after the program that the provider made of an instruction, and that program. The provider is asked
    once, and sees the table's structure only; a program over other fields is refused with NOT_A_PROGRAM."""
    from . import records

    if not instruction.strip():
        raise Refused("INPUT_REQUIRED", "the instruction is empty", "instruction")
    fields = records.fields_of(df)
    form = records.schema_of(fields)
    asked = f"Make a program of the operations below that does this and nothing else: {instruction.strip()}\n\nFields:\n{structural_sample(df.select(*map(records.col, fields)))}\n\nForm:\n{outline(form)}"
    try:
        program = json.loads(provider([(asked, json.dumps(form))])[0])
    except ValueError:
        raise Refused("NOT_A_PROGRAM", "the provider gave no JSON", "program") from None
    steps = records.validate(program, fields)
    return records.run(df, steps), steps


def decisions(df: DataFrame, title: Column, identifier: Column, threshold: float = 0.7) -> DataFrame:
    """Decision records of the rows ``judge`` gave for ``decide``."""
    r = F.col("reply")
    return df.select(title.alias("title"), identifier.alias("identifier"), r["result"].alias("value"), r["confidence"].alias("confidence"), r["reason"].alias("reason"), (r["confidence"] < threshold).alias("confidence_below_threshold"))
