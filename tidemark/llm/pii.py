"""Personal data by fixed forms and by bootstrapped contextual extraction.

Base spans (e-mail addresses, IP addresses, card and phone numbers) follow fixed forms. They are the seeds of the
bootstrap: what stands around a seed is a lexical pattern for its kind - two words or one before it, a word behind it, a word
on either side, or the start or end of its line - and whatever identifier-shaped token stands there elsewhere is an instance
of that pattern. Patterns of one side ask for a token of the seed's form too (something before an @, digits and signs only, or
neither), as one word alone says little. Spark scores the graph of patterns and instances in rounds, as two views that
teach each other: a pattern is as good as the instances it extracts; a seed counts 1, a base span of another kind 0, and any
other instance what the high-confidence patterns of the other side make of it, at best. So no pattern is held up by itself, nor
by a wider or narrower form of itself, and two poor ones do not raise each other. Likely instances induce patterns in turn. High-confidence patterns then add the unseen
identifiers they extract, under the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_batches

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_SCORE = 0.6
MIN_BELIEF = 0.8
ROUNDS = 8
GENERATIONS = 4
SETTLED = 1e-3
WORD = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = ".,;:!?\"'()[]{}<>|"


def _emails(text: str):
    """Leftmost, non-overlapping, in linear time: every match has its @, and starts where the run before it starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] not in "@" and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        if len(parts) < 4:
            continue
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _cards(text: str):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start, in code points; none for a null or empty text."""
    if not text:
        return []
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        found += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
    return found


_HAS_DIGIT = re.compile("[0-9]")


def _words(text: str, at: int, step: int, most: int) -> list[str]:
    """Up to ``most`` words before (step -1) or behind (step 1) a position, nearest first, lower-cased; a mark where the line
    starts or ends. None from a word of over ``WORD`` characters on: such runs are no pattern's words."""
    words: list[str] = []
    here = lambda i: text[i - 1] if step < 0 else text[i]
    left = lambda i: i > 0 if step < 0 else i < len(text)
    while len(words) < most:
        while left(at) and here(at).isspace() and here(at) != "\n":
            at += step
        if not left(at) or here(at) == "\n":
            return [*words, EDGE_OF_LINE]
        begin = at
        while left(at) and not here(at).isspace():
            at += step
            if abs(at - begin) > WORD:
                return words
        words.append(text[min(at, begin) : max(at, begin)].lower())
    return words


EDGE_OF_LINE = "\n"


def _form(token: str) -> str:
    return "@" if token.find("@") > 0 else "9" if not any(map(str.isalpha, token)) else "a"


def _contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that a token stands in, each by its side (L, R or both: B), its words and the token's form."""
    before, behind, form = _words(text, start, -1, 2), _words(text, end, 1, 1), _form(text[start:end])
    out = [f"L {form} {before[0]}"] if before else []
    if len(before) == 2:
        out.append(f"L {before[1]} {before[0]}")
    if behind:
        out.append(f"R {form} {behind[0]}")
    if before and behind and EDGE_OF_LINE not in (before[0], behind[0]):
        out.append(f"B {before[0]} {behind[0]}")
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, row_id, kind, start, end, contexts, value): base spans, and identifier-shaped tokens (a digit or @ in them,
    five characters or more) outside of base spans with a null kind. row_id tells rows apart that repeat a doc_id."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text:
                continue
            found: list[tuple[str | None, int, int]] = list(base_spans(text))
            taken = sorted((s, e) for _, s, e in found)
            if "@" in text or _HAS_DIGIT.search(text):
                i = 0
                for m in _SHAPED.finditer(text):
                    s, e = m.span()
                    while e > s and text[e - 1] in _EDGE:
                        e -= 1
                    while s < e and text[s] in _EDGE:
                        s += 1
                    while i < len(taken) and taken[i][1] <= s:
                        i += 1
                    if e - s >= 5 and not (i < len(taken) and taken[i][0] < e):
                        found.append((None, s, e))
            for kind, s, e in found:
                for col, v in zip(cols, (doc, row, kind, s, e, _contexts(text, s, e), text[s:e]), strict=True):
                    col.append(v)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row_id", "kind", "start", "end", "contexts", "value"])

    return map_batches(_keyed(docs), one, "doc_id bigint, row_id string, kind string, start bigint, end bigint, contexts array<string>, value string")


_SHAPED = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("row_id"), "text")


def _belief(edges: DataFrame, patterns: DataFrame, *by: str) -> DataFrame:
    """(value, kind, by..., belief): an instance is as likely of the kind as the best of its patterns makes it."""
    return edges.join(patterns, ["context", "kind"]).groupBy("value", "kind", *by).agg(F.max("score").alias("belief"))


def _settled(edges: DataFrame, scratch: Scratch, rounds: int, min_score: float) -> DataFrame:
    """(context, kind, score), scored until no pattern moves by more than ``SETTLED``, at most ``rounds`` times."""
    patterns = scratch.save(edges.groupBy("context", "kind").agg(F.avg(F.col("seed").cast("double")).alias("score")), "patterns")
    for _ in range(rounds):
        # base spans are settled either way; others count for one side what the other side's good patterns say
        value = F.when(F.col("seed"), 1.0).when(F.col("based"), 0.0).otherwise(F.coalesce("belief", F.lit(0.0)))
        side = F.left("context", F.lit(1))
        opposite = F.when(side == "L", "R").when(side == "R", "L")
        taught = _belief(edges.where("NOT based").withColumn("view", opposite), patterns.where(F.col("score") >= min_score), "view").where("view IS NOT NULL")
        after = edges.withColumn("view", side).join(taught, ["value", "kind", "view"], "left").groupBy("context", "kind").agg(F.avg(value).alias("score"))
        after = scratch.save(after, "patterns")
        moved = after.join(patterns.withColumnRenamed("score", "was"), ["context", "kind"]).agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        scratch.drop(patterns)
        patterns = after
        if (moved or 0.0) < SETTLED:
            break
    return patterns


def score_patterns(found: DataFrame, scratch: Scratch, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS, min_score: float = MIN_SCORE, generations: int = GENERATIONS) -> DataFrame:
    """(context, kind, score): patterns that hold at least ``min_seeds`` distinct seeds of one kind, scored over the
    graph of patterns and the distinct values that they extract. Instances that high-confidence patterns make likely are
    the seeds of the next generation's patterns, until none is new."""
    seen = scratch.save(found.select(F.explode("contexts").alias("context"), F.col("kind").alias("own"), "value").distinct(), "contexts")
    base = seen.where("own IS NOT NULL").select("context", F.col("own").alias("kind"), "value")
    seeds, known, patterns = base, -1, None
    for _ in range(generations):
        induced = seeds.groupBy("context", "kind").agg(F.countDistinct("value").alias("seeds")).where(F.col("seeds") >= min_seeds).select("context", "kind")
        seed = F.coalesce(F.col("own") == F.col("kind"), F.lit(False))
        edges = scratch.save(seen.join(induced, "context").select("context", "kind", "value", seed.alias("seed"), F.col("own").isNotNull().alias("based")), "edges")
        patterns = _settled(edges, scratch, rounds, min_score)
        good = patterns.where(F.col("score") >= min_score)
        if (now := good.count()) <= known:
            break
        known = now
        likely = _belief(edges.where("NOT based"), good).where(F.col("belief") >= MIN_BELIEF).select("value", "kind")
        seeds = base.union(seen.where("own IS NULL").join(likely, "value").select("context", "kind", "value"))
    return patterns


def discovered(found: DataFrame, scratch: Scratch, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, row_id, kind, start, end) of identifiers outside of base spans that high-confidence patterns extract; where
    patterns of two kinds fit one place, the better kind (ties: as listed)."""
    good = score_patterns(found, scratch, min_seeds, rounds, min_score).where(F.col("score") >= min_score)
    best = good.groupBy("context").agg(F.min(F.struct(-F.col("score"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "kind")).alias("b")).select("context", "b.kind", (-F.col("b.col1")).alias("score"))
    new = found.where("kind IS NULL").select("doc_id", "row_id", "start", "end", F.explode("contexts").alias("context")).join(best, "context")
    order = F.struct(-F.col("score"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    return new.groupBy("doc_id", "row_id", "start", "end").agg(F.min_by("kind", order).alias("kind"))


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, row_id, text_spans) for each row with any span: array of (kind, start, end, base), by kind as listed, then
    start. Rows that repeat doc_id and text have the same spans once. Null and empty texts have none."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.save(mentions(docs), "mentions")
    base = found.where("kind IS NOT NULL").select("doc_id", "row_id", "kind", "start", "end", F.lit(True).alias("base"))
    new = discovered(found, scratch, min_seeds, min_score, rounds).select("doc_id", "row_id", "kind", "start", "end", F.lit(False).alias("base"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = base.union(new).distinct().groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("s"))
    return spans.select("doc_id", "row_id", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("text_spans"))


def find_all(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts of base spans by kind, digest of base spans, all spans as text.
    A null text is empty; a document without spans has counts of 0, the digest of nothing and an empty string."""
    spans = find(docs, **options)
    ids = _keyed(docs).select("doc_id", "row_id")
    held = ids.join(
        spans.select(F.col("doc_id").alias("d"), F.col("row_id").alias("r"), "text_spans"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_id") == F.col("r")),
        "left",
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    s = F.coalesce("text_spans", none)
    of_base = F.filter(s, lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(of_base, lambda x: x["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return held.select("doc_id", *counts, F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; n_chars, where there is one, follows the new text. Spans
    that overlap are replaced together, under the first one's kind. All rows and columns stay, whatever their names."""
    found = find(docs, **options)
    doc, row, spans = (fresh(docs, n) for n in ("doc", "row", "spans"))
    by = found.select(F.col("doc_id").alias(doc), F.col("row_id").alias(f"{row}_"), F.col("text_spans").alias(spans))
    held = docs.withColumn(row, F.md5(F.col("text").cast("binary"))).join(by, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(f"{row}_")), "left")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def masked(text: str, found: list[dict]) -> str:
        out, at = [], 0
        for s, e, kind in sorted((x["start"], x["end"], x["kind"]) for x in found):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, cols = batch.column(batch.num_columns - 1), list(batch.columns[:-1])
        some = np.nonzero(spans.is_valid().to_numpy(zero_copy_only=False))[0]
        if len(some):  # all other texts stay as they are
            texts = cols[at].take(pa.array(some)).to_pylist()
            new = pa.array([masked(t, f) for t, f in zip(texts, spans.take(pa.array(some)).to_pylist(), strict=True)], cols[at].type)
            where = spans.is_valid()
            cols[at] = pc.replace_with_mask(cols[at], where, new)
            if chars is not None:
                cols[chars] = pc.replace_with_mask(cols[chars], where, pc.utf8_length(new).cast(cols[chars].type))
        return pa.record_batch(cols, schema=pa.schema([f.with_nullable(True) for f in list(batch.schema)[:-1]]))

    # Arrow functions take plain names only
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    named = [F.col("`" + c.replace("`", "``") + "`").alias(f.name) for c, f in zip(docs.columns, plain, strict=True)]
    return map_batches(held.select(*named, spans), one, T.StructType(plain)).toDF(*docs.columns)


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
