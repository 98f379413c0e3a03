"""Vectors in blocks: a stated query set against all rows as pairs of blocks.

Rows are packed into blocks of a fixed number of vectors, one row of binary columns each. Query blocks are repeated for
each slice of the candidates and joined on the slice number, so the join makes a row per pair of blocks, streamed into
numpy; vectors are shuffled once, never per pair of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def clean_vectors(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null or non-finite components; of rows that repeat an id, the one
    with the smallest vector. Stored, as it is read for queries and for candidates."""
    v = F.col(vector_col).cast("array<double>")
    # NaN counts as the largest, and a search among nulls that finds nothing is null
    finite = (F.size(v) == 0) | (~F.array_contains(v, F.lit(float("nan"))) & (F.array_max(v) < float("inf")) & (F.array_min(v) > -float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return scratch.save(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


def pack(df: DataFrame, per_block: int, n_rows: int, key: str, value: str, dims: int, as_read: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(block, ids, matrix): blocks of about ``per_block`` rows by hash of the key; ids little-endian 64-bit, the matrix as
    ``as_read`` makes it, row by row, shorter vectors padded with zeros to ``dims``."""
    blocks = max(1, math.ceil(n_rows / per_block))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(ids := table.column("k").to_numpy(), kind="stable")
        m = padded(table.column("v").combine_chunks(), dims)[order]
        return pa.table({"block": [table.column("b")[0].as_py()], "ids": [ids[order].astype("<i8").tobytes()], "matrix": [shown(as_read(m) if as_read else m)]})

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"), F.col(key).alias("k"), F.col(value).alias("v"))
    return dealt.groupBy("b").applyInArrow(build, "block bigint, ids binary, matrix binary")


def padded(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` doubles, one at least, zeros behind the shorter ones."""
    sizes, flat = pc.list_value_length(vectors).to_numpy(), vectors.flatten().to_numpy()
    if (sizes == max(dims, 1)).all():
        return flat.reshape(len(sizes), -1)
    m = np.zeros((len(sizes), max(dims, 1)))
    m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return m


KINDS = ("<i2", "<f4", "<f8")


def shown(m: np.ndarray) -> bytes:
    """A matrix in the shortest kind of number that holds each component as it is, behind the place of the kind."""
    with np.errstate(all="ignore"):
        kind = next(i for i, x in enumerate(KINDS) if x == "<f8" or np.array_equal(m.astype(x), m))
    return bytes([kind]) + np.ascontiguousarray(m, KINDS[kind]).tobytes()


def read(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the matrix in its kind of number."""
    keys = np.frombuffer(ids, dtype="<i8")
    return keys, np.frombuffer(matrix, dtype=KINDS[memoryview(matrix)[0]], offset=1).reshape(len(keys), -1)


def against(queries: DataFrame, candidates: DataFrame, slices: int, hint: str | None = None) -> DataFrame:
    """Rows (q_*, c_*) for each query block with each candidate block. ``hint`` for the join: the repeated query blocks
    compress so well that their size in a shuffle says little about that of a broadcast."""
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), *(F.col(c).alias(f"q_{c}") for c in queries.columns))
    c = candidates.select(F.pmod(F.col("block"), F.lit(slices)).cast("int").alias("slice"), *(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    return c.join(q.hint(hint) if hint else q, "slice")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id; Spark limits each group before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Held:
    """The k best of each query of a block so far, by score, ties by id; scores are of the kind of ``lowest``."""

    def __init__(self, ids: np.ndarray, k: int, lowest: float):
        self.ids, self.k = ids, k
        self.kind = np.int64 if isinstance(lowest, int) else np.float64
        self.least = np.full(len(ids), lowest, dtype=self.kind)  # a score that the k best so far reach, and
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # the largest id among them with that score
        self.row, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def take(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        fits = (score > self.least[row]) | (score == self.least[row]) & (vec < self.last[row])
        if not fits.any():
            return
        row, vec, score = (np.concatenate([x, new[fits]]) for x, new in zip((self.row, self.vec, self.score), (row, vec, score), strict=True))
        order = np.lexsort((vec, ~score if self.kind is np.int64 else -score, row))
        row, vec, score = row[order], vec[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.least[row[full]], self.last[row[full]] = score[full], vec[full]
        self.row, self.vec, self.score = (x[place < self.k] for x in (row, vec, score))

    def out(self) -> pa.RecordBatch:
        """What is held, and no longer after that; later ones still have to be better."""
        batch = pa.record_batch([pa.array(x) for x in (self.ids[self.row], self.vec, self.score)], names=["query_id", "vec_id", "score"])
        self.row, self.vec, self.score = self.row[:0], self.vec[:0], self.score[:0]
        return batch
