"""Exact top-k by integer inner product: columnar branch and bound over blocks of queries.

Components become integers floor(scale * x). A block of candidates is laid out dimension by dimension, the dimensions of
the largest mass first. Products of a tile of queries accumulate over the leading dimensions, as one matrix product; what the
remaining dimensions can still add is bounded by the remaining mass of both vectors (Cauchy-Schwarz), and only pairs whose
bound reaches the k-th best score that their query has so far take part in the rest. How many dimensions lead is chosen for
each pair of blocks, by what a few of its queries would leave: all of them, where bounds prune nothing. A task goes through a
slice of blocks and keeps each query's k best meanwhile; slices meet in a limited window. The driver sees counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Held, against, best, clean_vectors, pack, read
from .common import Scratch, release_memory

GROUP = 16
QUERIES_PER_BLOCK = 1024
ROWS_PER_BLOCK = 4096
TILE = 128
SLICES = 48
BLOCKS_PER_SLICE = 64
HELD = 1 << 22
GATHER = 16  # times the cost of a product in a matrix, for one of a single pair
EXACT = float(1 << 53)
EXACT_SINGLE = float(1 << 24)
LOWEST = -(1 << 63)


def _inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; sums beyond its range are held at its ends."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(len(q), 1) < EXACT:
        return (c @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(q.tolist(), row, strict=True)) for row in c.tolist()]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], dtype=np.int64)


class Columns:
    """A block of candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.rows = ids, m.astype(float)
        with np.errstate(over="ignore"):
            squares = self.rows * self.rows
            self.order = np.argsort(-squares.sum(axis=0), kind="stable")
            # by dimension: the largest mass that is left from there on
            left = np.cumsum(squares[:, self.order][:, ::-1], axis=1)[:, ::-1].max(axis=0, initial=0)
        self.rest = np.sqrt(np.append(left, 0.0))
        self.plain = np.abs(self.rows).max(initial=0)
        self.columns: dict[type, np.ndarray] = {}

    def laid(self, kind: type) -> np.ndarray:
        if kind not in self.columns:
            self.columns[kind] = np.ascontiguousarray(self.rows[:, self.order].T, kind)
        return self.columns[kind]

    def pairs(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's row, candidate's row, score) of pairs that reach their query's ``least``, but for a query's own id: all that
        may be among its k best."""
        q = q.astype(float)
        if np.abs(q).max(initial=1) * max(self.plain, 1) * max(q.shape[1], 1) >= EXACT:
            for i, vector in enumerate(q):
                scores = _inner(vector, self.rows)
                at = np.flatnonzero((scores >= least[i]) & (self.ids != query_ids[i]))
                yield np.full(len(at), i), at, scores[at]
            return
        q = q[:, self.order]
        left = np.sqrt(np.append(np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1)), axis=1))
        kind = np.float32 if left[:, 0].max(initial=0) * self.rest[0] < EXACT_SINGLE else np.float64
        columns, q, dims = self.laid(kind), np.ascontiguousarray(q, kind), q.shape[1]
        # sums are exact below 2 ** 24 and 2 ** 53; bounds are not, so they give way a little
        reach = least[:, None] * 1.0 - left * self.rest * (1 + 1e-6)
        reach = np.where(np.arange(dims + 1) < dims, reach - 1e-6 * np.abs(reach) - 2, least[:, None]).astype(kind)
        lead = self._lead(columns, q, reach)
        own = np.minimum(np.searchsorted(self.ids, query_ids), len(self.ids) - 1)
        own = np.where(self.ids[own] == query_ids, own, -1)
        for a in range(0, len(q), TILE):
            part = q[a : a + TILE, :lead] @ columns[:lead]
            here = np.flatnonzero(own[a : a + TILE] >= 0)
            part[here, own[a + here]] = -np.inf
            bar = reach[a : a + TILE, lead]
            if lead == dims and (new := least[a : a + TILE] == LOWEST).any() and part.shape[1] > k:
                bar[new] = np.partition(part[new], -k, axis=1)[:, -k]  # ties with the k-th stay until ids decide
            at = np.flatnonzero(part >= bar[:, None])
            row, col = at // part.shape[1], at % part.shape[1]
            scores, fits = part.ravel()[at], own[a + row] != col
            row, col, scores = row[fits] + a, col[fits], scores[fits]
            for b in range(lead, dims, GROUP):  # few pairs are left, and fewer with each group
                scores = scores + np.einsum("rd,dr->r", q[row, b : b + GROUP], columns[b : b + GROUP, col])
                fits = scores >= reach[row, min(b + GROUP, dims)]
                row, col, scores = row[fits], col[fits], scores[fits]
            yield row, col, scores.astype(np.int64)

    def _lead(self, columns: np.ndarray, q: np.ndarray, reach: np.ndarray) -> int:
        """How many dimensions all pairs take part in: the cheapest number for a few queries."""
        dims, some = len(columns), np.linspace(0, len(q) - 1, min(len(q), 8)).astype(int) if len(q) else []
        if not len(some) or not np.isfinite(reach[some]).all() or (reach[some, dims] <= LOWEST).any():
            return dims
        least, lead, part = float(dims), dims, 0.0
        for c in range(GROUP, dims, GROUP):
            part = part + q[some, c - GROUP : c] @ columns[c - GROUP : c]
            cost = c + GATHER * dims * float((part >= reach[some, c][:, None]).mean())
            if cost < least:
                least, lead = cost, c
        return lead


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        block, columns = None, None
        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    c_block, c_ids, c_matrix, q_block, q_ids, q_matrix = (batch.column(x)[r] for x in ("c_block", "c_ids", "c_matrix", "q_block", "q_ids", "q_matrix"))
                    if c_block.as_py() != block:
                        block, columns = c_block.as_py(), Columns(*read(c_ids.as_py(), c_matrix.as_py()))
                    ids, q = read(q_ids.as_py(), q_matrix.as_py())
                    mine = held.setdefault(q_block.as_py(), Held(ids, k, LOWEST))
                    for row, col, score in columns.pairs(ids, q, k, mine.least):
                        mine.take(row, columns.ids[col], score)
                if sum(len(x.row) for x in held.values()) > HELD:
                    yield from (x.out() for x in held.values())
            yield from (x.out() for x in held.values())
        finally:
            release_memory()

    return search


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k rows of largest integer
    inner product, but for its own; all of them, if fewer; ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Of rows that
    repeat a vec_id the one with the smallest vector does. A vector that is shorter than another counts as padded with
    zeros; an empty one has score 0 with all. Scaled components beyond 1e300 are held there, scores beyond a long at its ends. Other columns are not read;
    without queries or candidates there are no rows.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = clean_vectors(df, scratch)
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()

    def whole(m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            m = m * scale
        return np.where(np.abs(m) < 2.0**62, np.floor(m), np.clip(m, -1e300, 1e300))

    candidates = scratch.save(pack(rows, ROWS_PER_BLOCK, n, "vec_id", "v", dims, whole), "candidates")
    queries = pack(rows.where(F.col("vec_id") % every == 0), QUERIES_PER_BLOCK, n_queries, "vec_id", "v", dims, whole)
    blocks = max(1, math.ceil(n / ROWS_PER_BLOCK))
    # queries travel once for each slice, however many blocks it has
    slices = min(blocks, max(SLICES, math.ceil(blocks / BLOCKS_PER_SLICE)))
    found = against(queries, candidates, slices, "merge").mapInArrow(_searcher(k), "query_id bigint, vec_id bigint, score bigint")
    return best(found, k)
