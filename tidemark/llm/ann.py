"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards of a bounded size by hash. In a shard, points join the graph in batches: a greedy beam
search from the entry point proposes neighbours, relaxed distance pruning keeps a diverse few, and reverse edges are
added: as they come while a node has places left, under the same pruning once it has none. A query is searched by beam in every
shard, and the shards' results merge. All of a batch moves in step, as numpy arrays. Equal vectors share one node, which holds
the smallest ids that a result could show.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Held, against, best, clean_vectors, pack, padded, read, shown
from .common import Scratch, release_memory

SHARD = 5_000
DEGREE = 24
PLACES = 36
BEAM = 64
RELAX = 1.2
SAME = 1e-6
STEP = 4
BATCH = 512
CELLS = 1 << 20
QUERIES_PER_BLOCK = 1024
SLICES = 48
SHARDS_PER_SLICE = 64
HELD = 1 << 22


def _unit(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, keepdims=True, initial=0)
    m = m / np.where(big > 0, big, 1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and distances (1 - cosine) of the ``beam`` nearest points met, nearest first; -1 fills up."""
    most = max(1, CELLS // (len(points) + 1))
    found = [_walk(points, graph, entry, queries[a : a + most], beam) for a in range(0, max(len(queries), 1), most)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _walk(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, b = len(points), len(queries)
    met = np.zeros((b, n + 1), dtype=np.int32)
    met[:, n] = met[:, entry] = 1  # the last is where absent neighbours point
    met = met.ravel()
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    ahead = np.zeros((b, beam), dtype=bool)
    ids[:, 0], dist[:, 0], ahead[:, 0] = entry, 1 - queries @ points[entry], True
    active = np.arange(b)
    while len(active):
        rank = np.cumsum(ahead[active], axis=1)  # beams are sorted: the first ones ahead are the nearest
        going = rank[:, -1] > 0
        active, rank = active[going], rank[going]
        row, col = np.nonzero(ahead[active] & (rank <= STEP))
        ahead[active[row], col] = False
        near = graph.take(ids[active[row], col], 0)
        cell = ((active[row] * (n + 1))[:, None] + np.where(near < 0, n, near)).ravel()
        new = np.flatnonzero(met.take(cell) == 0)
        cell, mark = cell.take(new), np.arange(1, len(new) + 1, dtype=np.int32)
        met[cell] = mark
        new = new.compress(met.take(cell) == mark)  # a point that several neighbours lead to counts once
        row, node = row.take(new // near.shape[1]), near.ravel().take(new)
        far = 1 - np.vecdot(points.take(node, 0), queries.take(active.take(row), 0))
        fits = far < dist[active[row], -1]
        row, node, far = row[fits], node[fits], far[fits]
        if not len(row):
            continue
        count = np.bincount(row, minlength=len(active))
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        new_dist = np.full((len(active), count.max()), np.inf, dtype=np.float32)
        new_ids = np.full(new_dist.shape, -1)
        new_dist[row, place], new_ids[row, place] = far, node
        all_dist = np.concatenate([dist[active], new_dist], axis=1)
        top = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_dist, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new_ids], axis=1), top, 1)
        ahead[active] = np.take_along_axis(np.concatenate([ahead[active], new_ids >= 0], axis=1), top, 1)
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node up to ``degree`` of its proposed neighbours: the nearest left is kept, and proposals that lie
    nearer to it, by the factor ``relax``, than to the node go. Those in the node's own direction prune nothing of each other, up to
    half of the degree: all of them would lie nearer to the first than to the node."""
    near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # a point proposed twice counts once
    to_node = 1 - np.matmul(points[np.where(near < 0, 0, near)], points[nodes][:, :, None])[:, :, 0]
    to_node[near < 0] = np.inf
    there = points[np.where(near < 0, 0, near)]
    between = 1 - np.matmul(there, there.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1)
    rows, same = np.arange(len(nodes)), to_node < SAME
    for j in range(degree):
        if j == degree // 2:
            to_node[same] = np.inf
            same[:] = False
        pick = np.argmin(to_node, axis=1)
        live = np.isfinite(to_node[rows, pick])
        if not live.any():
            break
        out[live, j] = near[rows[live], pick[live]]
        to_node[(relax * np.maximum(between[rows, pick], 0) <= to_node) & live[:, None] & ~same] = np.inf
        to_node[rows, pick] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(neighbours per point, -1 fills up; entry point) over unit vectors."""
    n, places = len(points), degree * PLACES // DEGREE
    entry = int(np.argmax(points @ points.mean(axis=0)))
    graph, used = np.full((n, places), -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])

    def prune(nodes: np.ndarray, near: np.ndarray) -> None:
        for a in range(0, len(nodes), BATCH):
            held = nodes[a : a + BATCH]
            kept = robust_prune(points, held, near[a : a + BATCH], degree, relax)
            graph[held, :degree], graph[held, degree:] = kept, -1
            used[held] = (kept >= 0).sum(axis=1)

    at, size, width = 1, 8, 2 * degree
    while at < n:
        batch = order[at : at + min(size, BATCH)]
        ids, _ = beam_search(points, graph, entry, points[batch], beam)
        # points of one batch don't see each other in the graph yet
        mates = np.argsort(-(points[batch] @ points[batch].T), axis=1)[:, : degree // 2]
        prune(batch, np.concatenate([ids, batch[mates]], axis=1))
        src, dst = np.repeat(batch, degree), graph[batch, :degree].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        while len(dst):  # a hub takes its reverse edges in several rounds
            targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(starts, counts)
            roomy = used[targets] + counts <= places
            free = np.repeat(roomy, counts)
            graph[dst[free], used[dst[free]] + place[free]] = src[free]
            used[targets[roomy]] += counts[roomy]
            crowded, now = targets[~roomy], ~free & (place < width)
            new = np.full((len(crowded), width), -1)
            new[np.searchsorted(crowded, dst[now]), place[now]] = src[now]
            prune(crowded, np.concatenate([graph[crowded], new], axis=1))
            src, dst = src[~free & ~now], dst[~free & ~now]
        at, size = at + len(batch), size * 2
    return graph, entry


def first_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(h, vec_id, v, nth): ``rows`` (vec_id, v) with a hash of the vector, the ``keep`` smallest ids of each distinct vector, counted
    from 1. The hash comes first in the sort, as arrays are slow to compare."""
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    return rows.select(F.xxhash64("v").alias("h"), "vec_id", "v").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep)


def distinct(ids: np.ndarray, m: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each distinct row of ``m``, -1 fills up; the distinct rows), by their smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], np.ascontiguousarray(m[order] + 0.0)
    _, first, which = np.unique(m.view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    nth = np.arange(len(ids)) - np.searchsorted(which[by], which[by])
    own, by, nth = np.full((len(first), keep), -1), by[nth < keep], nth[nth < keep]  # more where padding makes vectors equal
    own[which[by], nth] = ids[by]
    order = np.argsort(first)
    return own[order], m[first[order]]


def build_index(rows: DataFrame, n: int, dims: int, keep: int, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(block, ids, matrix, graph, entry): one row per shard over the ``n`` distinct vectors of ``first_ids``. ids hold ``keep``
    smallest ids per node, -1 fills up. A DataFrame: write it to keep the index."""
    shards = max(1, math.ceil(n / shard))

    def build(table: pa.Table) -> pa.Table:
        own, m = distinct(table.column("vec_id").to_numpy(), padded(table.column("v").combine_chunks(), dims), keep)
        graph, entry = build_graph(_unit(m).astype(np.float32), degree, beam)
        cols = [table.column("b")[0].as_py(), own.astype("<i8").tobytes(), shown(m), graph.astype("<i4").tobytes(), entry]
        return pa.table([[c] for c in cols], names=["block", "ids", "matrix", "graph", "entry"])

    dealt = rows.select(F.pmod("h", F.lit(shards)).alias("b"), "vec_id", "v")
    return dealt.groupBy("b").applyInArrow(build, "block bigint, ids binary, matrix binary, graph binary, entry bigint")


class Shard:
    """A shard of the index, as a task reads it."""

    def __init__(self, ids: bytes, matrix: bytes, graph: bytes, entry: int, keep: int):
        self.own = np.frombuffer(ids, dtype="<i8").reshape(-1, keep)
        self.m = read(bytes(8 * len(self.own)), matrix)[1].astype(float)
        self.graph, self.entry = np.frombuffer(graph, dtype="<i4").reshape(len(self.own), -1), entry
        self.unit = _unit(self.m).astype(np.float32)

    def near(self, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, vec_id, cosine) of points near each query that may reach its ``least``."""
        ids, dist = beam_search(self.unit, self.graph, self.entry, _unit(q).astype(np.float32), max(beam, k + 1))
        ids, dist = ids[:, : 4 * (k + 1)], dist[:, : 4 * (k + 1)]
        row, col = np.nonzero((ids >= 0) & (1 - dist >= least[:, None] - 1e-5))  # distances are in single precision
        node = ids[row, col]
        score, named = cosine(q[row], self.m[node]), self.own[node]
        fits = (named >= 0) & (named != query_ids[row][:, None])
        at, which = np.nonzero(fits)
        return row[at], named[at, which], score[at]


def search(index: DataFrame, queries: DataFrame, shards: int, k: int, keep: int, beam: int = BEAM) -> DataFrame:
    """The k nearest found of each query in all shards. ``queries``: blocks of (block, ids, matrix). A task goes through a slice
    of shards and keeps each query's k best meanwhile."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        block, shard = None, None
        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    at = lambda name: batch.column(name)[r].as_py()  # noqa: B023, E731
                    if at("c_block") != block:
                        block, shard = at("c_block"), Shard(at("c_ids"), at("c_matrix"), at("c_graph"), at("c_entry"), keep)
                    ids, q = read(at("q_ids"), at("q_matrix"))
                    mine = held.setdefault(at("q_block"), Held(ids, k, -np.inf))
                    mine.take(*shard.near(ids, q.astype(float), k, beam, mine.least))
                if sum(len(x.row) for x in held.values()) > HELD:
                    yield from (x.out() for x in held.values())
            yield from (x.out() for x in held.values())
        finally:
            release_memory()

    # queries travel once for each slice, however many shards it has
    slices = min(shards, max(SLICES, math.ceil(shards / SHARDS_PER_SLICE)))
    return best(against(queries, index, slices, "merge").mapInArrow(walk, "query_id bigint, vec_id bigint, score double"), k)


def cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of rows, in double precision on the original vectors; scaled by the largest component first where squares would overflow."""
    big_q, big_m = (np.abs(x).max(axis=1, keepdims=True, initial=0) for x in (q, m))
    odd = (np.maximum(big_q, big_m) > 1e150) | (np.minimum(big_q, big_m) < 1e-150)
    if odd.any():
        q, m = np.where(odd, q / big_q, q), np.where(odd, m / big_m, m)
    return np.einsum("nd,nd->n", q, m) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((m * m).sum(axis=1)))


def nearest(df: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k nearest found of all
    other rows by cosine (all of them, if fewer), nearest first, ties to the smaller vec_id.

    Vectors that are null, zero or empty or hold null or non-finite components, and rows without vec_id, take no part; of
    rows that repeat a vec_id the one with the smallest vector does. A shorter vector counts as padded with zeros. Other
    columns are not read; without queries or candidates there are no rows.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = clean_vectors(df, scratch).where(F.exists("v", lambda x: x != 0.0))
    n_queries, dims = rows.agg(F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    firsts = scratch.save(first_ids(rows, k + 1), "firsts")
    n = firsts.where("nth = 1").count()  # copies of a vector make no shards
    index = scratch.save(build_index(firsts, n, dims, k + 1, shard, degree, beam), "index", arrow_rows=16)
    queries = pack(rows.where(F.col("vec_id") % every == 0), QUERIES_PER_BLOCK, n_queries, "vec_id", "v", dims)
    return search(index, queries, max(1, math.ceil(n / shard)), k, k + 1, beam)
