"""Quality rules with risk-controlled thresholds.

A document's words, symbols, lines and repetitions give five signals, each a whole number that is larger for a worse text. A
rule rejects documents whose signal reaches a cutoff. Which cutoff holds in a stratum (a language, say) is decided by labelled
documents:

1. Labelled documents that pass the base rule are dealt to two folds by hash of their ids. The smaller fold only says what a
   cutoff is worth: bad documents rejected less good ones.
2. On the holdout, the cutoffs of a rule are tested from the most lenient on. That at most ``risk`` / rules of the stratum's
   good documents are rejected is held proven where the exact binomial probability of as few false rejections, at that rate,
   is at most ``error`` / (rules x strata) (Bonferroni); the first cutoff that is not proven ends its rule (fixed sequence, so
   the cutoffs themselves need no further correction).
3. Of the proven cutoffs the one worth most is used, the most lenient of equals, and none where none is worth anything.

So, but for a chance of ``error`` over all strata together, no stratum loses more than the share ``risk`` of its good
documents to the rules. A stratum with too few labels proves nothing, and loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches

RISK = 0.05
ERROR = 0.1
TUNING_OF = 5
MANY_STRATA = 10_000
BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Cutoffs of each rule, lenient first. Shares are in thousandths, word lengths in hundredths of a character.
CUTOFFS = {
    "symbols": [500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10],
    "repeated_lines": [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
    "repeated_words": [500, 450, 400, 350, 300, 250, 200, 150, 100],
    "long_words": [3000, 2500, 2000, 1600, 1400, 1200, 1100, 1000, 900, 800, 700],
    "short_words": [-100, -150, -200, -250, -300, -350, -400],
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    a = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    n, keys = len(known), a[:-2]
    for i in (1, 2):
        if n >= 1 << 20:  # keys of three words would not fit: pairs are numbered first
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * n + a[i : len(a) - 2 + i]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    again, inside = times[which] > 1, np.zeros(len(a), dtype=bool)
    for i in range(3):
        inside[i : len(a) - 2 + i] |= again
    return int(inside.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS``; words lie between ASCII white space, lines between line feeds."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    inside = raw.translate(None, BLANKS)
    points = len(inside) - int(np.count_nonzero((np.frombuffer(inside, dtype=np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x.translate(None, BLANKS)]
    return len(words), points, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measure(docs: DataFrame, strata: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(doc_id, stratum, the numbers of ``COUNTS``, base_failed) for every row. ``stratum`` is the JSON of the columns named."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_counts(t) for t in batch.column(2).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
        return pa.record_batch([batch.column(0), batch.column(1), *cols], names=["doc_id", "stratum", *COUNTS])

    quoted = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in strata]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.to_json(F.array(*quoted) if quoted else F.array(F.lit(""))).alias("stratum"), F.col("text").cast("string").alias("text"))
    counted = map_batches(rows, one, ", ".join(["doc_id bigint", "stratum string", *(f"{c} bigint" for c in COUNTS)]))
    few, repeats = F.col("n_words") < 50, 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return counted.withColumn("base_failed", few | repeats)


def _levels() -> dict[str, Column]:
    """For each rule, the first of its cutoffs, counted from 1, that a document's signal reaches; one past the last for none."""
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(F.lit(1000) * F.col(a) / F.col(b))).otherwise(0)
    length = F.when(F.col("n_words") > 0, F.floor(F.lit(100) * F.col("word_chars") / F.col("n_words"))).otherwise(0)
    signals = {
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "long_words": length,
        "short_words": -length,
    }
    return {rule: sum((F.when(s < c, 1).otherwise(0) for c in CUTOFFS[rule]), F.lit(1)) for rule, s in signals.items()}


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n trials at rate p, summed term by term from exact ratios; 1 where k reaches the mean, as
    nothing is proven there."""
    step = lambda acc, i: F.struct((acc["l"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("l"), acc["s"].alias("s"))
    add = lambda x: F.struct(x["l"].alias("l"), (x["s"] + F.exp(x["l"])).alias("s"))
    start = n * math.log(1 - p)
    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), F.struct(start.alias("l"), F.exp(start).alias("s")), lambda acc, i: add(step(acc, i)), lambda acc: acc["s"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(total)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, level, cutoff, good, lost, p_value): the cutoff in force for a rule of a stratum, counted from the most
    lenient; ``good`` and ``lost`` are the holdout's good documents and those among them it rejects.

    ``labels``: (doc_id, quality), 1 is good and 0 bad. Other labels count as none; ids with both labels take no part, and
    repeated rows count once.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    clear = named.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level.alias("level")) for r, level in _levels().items())))
    known = measured.where("NOT base_failed").join(clear, "doc_id").withColumn("tuning", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TUNING_OF)) == 0)
    one = known.select("stratum", "tuning", "quality", rules.alias("r")).select("stratum", "tuning", "quality", "r.*")
    counted = one.groupBy("stratum", "rule", "level").agg(
        F.count_if(~F.col("tuning") & (F.col("quality") == 1)).alias("good"),
        F.sum(F.when(F.col("tuning"), 1 - 2 * F.col("quality")).otherwise(0)).alias("worth"),
    )
    # a row for each level of each rule and stratum, so that a cutoff that no document lies at is tested in its turn too
    grid = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level"), F.lit(c).alias("cutoff")) for r, cs in CUTOFFS.items() for i, c in enumerate([*cs, None], 1))))
    every = counted.select("stratum").distinct().select("stratum", grid.alias("g")).select("stratum", "g.*")
    full = every.join(counted, ["stratum", "rule", "level"], "left").fillna(0, ["good", "worth"])
    of_rule = Window.partitionBy("stratum", "rule")
    up_to = of_rule.orderBy("level")
    sums = full.select(
        "stratum", "rule", "level", "cutoff", F.sum("good").over(of_rule).alias("good"), F.sum("good").over(up_to).alias("lost"), F.sum("worth").over(up_to).alias("worth")
    ).where("cutoff IS NOT NULL")
    n = max(1, sums.where("good > 0").select("stratum").distinct().count())
    tested = sums.withColumn("p_value", at_most(F.col("lost"), F.col("good"), risk / len(CUTOFFS)))
    proven = F.max("p_value").over(up_to) <= error / (len(CUTOFFS) * n)
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("worth"), "level")
    held = tested.withColumn("proven", proven).where("proven AND worth > 0").withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return held.select("stratum", "rule", "level", "cutoff", "good", "lost", "p_value")


def judge(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...] = ("lang",), risk: float = RISK, error: float = ERROR, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) for every row of
    ``docs``: ``failed`` names the rules in force that the document fails, in alphabetical order.

    Null texts have no words and fail the base rule like all texts of under 50 words, or with most words in repeated windows of three. Rows without an id or with a
    repeated one are judged like any other. Null strata are a stratum of their own. Without labels only the base rule
    rejects. Columns of any other name are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    measured = scratch.save(measure(docs, strata), "measured")
    inforce = scratch.save(thresholds(measured, labels, risk, error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("limits")), "thresholds")  # five entries at most
    if inforce.count() <= MANY_STRATA:  # else Spark shuffles and splits large strata
        inforce = F.broadcast(inforce)
    failed = F.array_compact(F.array(*(F.when(~F.col("base_failed") & (level <= F.try_element_at("limits", F.lit(rule))), F.lit(rule)) for rule, level in sorted(_levels().items()))))
    out = measured.join(inforce, "stratum", "left").withColumn("failed", failed)
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
