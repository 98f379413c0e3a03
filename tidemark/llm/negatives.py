"""Hard-negative mining: vantage-point trees over norm-augmented vectors.

With M the largest norm of a tree's vectors, x becomes [x, sqrt(M^2 - |x|^2)] and a query q becomes [q, 0]; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest points, and a window of scores is an annulus of
distances. Distinct (vector, label) nodes are dealt to shards of a bounded size by hash, a tree for each. A tree halves its
points by their distance to a vantage point, again and again, and keeps the least and the largest distance of each half.

An anchor visits a tree's leaves nearest first, by the lower bounds that the triangle inequality gives; leaves that lie wholly
outside its annuli are left out, and it stops where no unvisited leaf can better what it holds. All anchors of a block move in
step, as numpy arrays. The first pass finds each anchor's positives, the second, with a window for each positive, the
negatives; shards' results meet in a limited window. Scores are whole numbers, checked on the original vectors; distances only
prune, with slack for their rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against
from .common import Scratch, map_batches
from .topk import EXACT, _inner

SHARD = 4096
LEAF = 64
ANCHORS = 128
LOWEST = -(1 << 63)


def grow(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vantage-point tree over the rows of ``m``: (vantages; for each leaf its row numbers, -1 fills up; for each leaf and
    level the vantage, the least and the largest distance). Halves are of equal size however the distances tie."""
    norms = (m * m).sum(axis=1)
    points = np.concatenate([m, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], axis=1)
    depth = max(0, math.ceil(math.log2(max(len(m), 1) / LEAF)))
    level, above, vantages = [np.arange(len(m))], [[]], []
    for _ in range(depth):
        below, ways = [], []
        for rows, way in zip(level, above, strict=True):
            # the point farthest from the first is near the edge, where distances differ most
            v = points[rows[np.argmax(((points[rows] - points[rows[0]]) ** 2).sum(axis=1))]]
            far = np.sqrt(((points[rows] - v) ** 2).sum(axis=1))
            order = np.argsort(far, kind="stable")
            for half in np.array_split(order, 2):
                below.append(rows[half])
                ways.append([*way, (len(vantages), far[half[0]], far[half[-1]])])
            vantages.append(v)
        level, above = below, ways
    width = max(map(len, level))
    leaves = np.array([np.concatenate([rows, np.full(width - len(rows), -1)]) for rows in level])
    return np.array(vantages).reshape(len(vantages), points.shape[1]), leaves, np.array(above, dtype=float).reshape(len(level), depth, 3)


class Tree:
    """A tree as ``grow`` made it, over vectors of the largest squared norm ``most``."""

    def __init__(self, most: float, vantages: np.ndarray, leaves: np.ndarray, ways: np.ndarray):
        self.most, self.vantages, self.leaves = most, vantages, leaves
        self.by, self.low, self.high = ways[:, :, 0].astype(int), ways[:, :, 1], ways[:, :, 2]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf): the largest and the smallest score that a leaf's points can have."""
        own = (q * q).sum(axis=1)
        if not self.by.shape[1]:
            reach = np.sqrt(own * self.most)[:, None] * np.ones((1, len(self.leaves)))
            return reach * (1 + 1e-9) + 1, -reach * (1 + 1e-9) - 1
        to = np.sqrt(np.maximum(own[:, None] + (self.vantages**2).sum(axis=1) - 2 * (q @ self.vantages[:, :-1].T), 0))[:, self.by]
        near = np.maximum(np.maximum(to - self.high, self.low - to).max(axis=2), 0)
        far = (to + self.high).min(axis=2)
        slack = 1e-6 * (own[:, None] + self.most) + 1
        score = lambda d: (own[:, None] + self.most - d * d) / 2
        return score(near) + slack, score(far) - slack


def traverse(tree: Tree, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, q: np.ndarray, q_labels: np.ndarray, windows: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window (low, high), both included, the ``k`` best rows of the anchor's own label (``same``) or of
    another: (row numbers, -1 fills up; scores), best first, ties by ``ids``, which are each row's smallest."""
    n, w = windows.shape[:2]
    exact = np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * max(q.shape[1], 1) < EXACT
    rows, scores, keys = np.full((n, w, k), -1), np.full((n, w, k), LOWEST), np.full((n, w, k), np.iinfo(np.int64).max)
    top, bottom = tree.bounds(q) if exact else (np.full((n, len(tree.leaves)), np.inf), np.full((n, len(tree.leaves)), -np.inf))
    low, high = windows[:, :, 0].astype(float), windows[:, :, 1].astype(float)
    order = np.argsort(-top, axis=1, kind="stable")
    active = np.arange(n)
    for r in range(len(tree.leaves)):
        leaf = order[active, r]
        reach, floor = top[active, leaf][:, None], bottom[active, leaf][:, None]
        worst = scores[active, :, -1].astype(float)
        open_ = (reach >= low[active]) & (reach >= worst * (1 - 1e-12 * np.sign(worst)))  # leaves to come reach no further
        going = open_.any(axis=1)
        active, leaf, floor, open_ = active[going], leaf[going], floor[going], open_[going]
        if not len(active):
            break
        inside = (open_ & (floor <= high[active])).any(axis=1)
        a, some = active[inside], tree.leaves[leaf[inside]]
        if not len(a):
            continue
        if exact:
            s = np.matmul(m[some], q[a][:, :, None])[:, :, 0].astype(np.int64)
        else:
            s = np.stack([_inner(x, m[y]) for x, y in zip(q[a], some, strict=True)])
        fits = (some >= 0) & ((labels[some] == q_labels[a][:, None]) == same)
        held = fits[:, None, :] & (s[:, None, :] >= windows[a, :, :1]) & (s[:, None, :] <= windows[a, :, 1:])
        shape = held.shape
        new = [np.where(held, np.broadcast_to(x[:, None, :], shape), e) for x, e in ((some, -1), (s, LOWEST), (ids[some], np.iinfo(np.int64).max))]
        all_rows, all_scores, all_keys = (np.concatenate([x[a], y], axis=2) for x, y in zip((rows, scores, keys), new, strict=True))
        best = np.lexsort((all_keys, -all_scores.astype(float) if exact else ~all_scores), axis=2)[:, :, :k]
        rows[a], scores[a], keys[a] = (np.take_along_axis(x, best, 2) for x in (all_rows, all_scores, all_keys))
    return rows, scores


def _clean(df: DataFrame, scale: int, shift: int, labels: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, with whole components and the labels that count."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(x * scale, F.lit(1e300)), F.lit(-1e300))
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("double")).otherwise(held(x)))
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    one = rows.select("vec_id", F.struct("label", whole.alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    label = F.when(F.col("vec_id") % shift == 0, (F.col("r.label") + 1) % labels).otherwise(F.col("r.label"))
    return one.select("vec_id", label.alias("label"), F.col("r.v").alias("v"))


def _shards(rows: DataFrame, n: int, dims: int, keep: int) -> DataFrame:
    """(block, ids, labels, matrix, vantages, leaves, ways): the distinct (vector, label) nodes with their ``keep`` smallest
    ids each, -1 fills up, which is all of them that a result can show, and the shard's tree."""
    w = Window.partitionBy("v", "label").orderBy("vec_id")
    small = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    nodes = small.groupBy("v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("own"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(max(dims, 1) - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0.0)))
    dealt = nodes.select(F.pmod(F.xxhash64(F.col("own")[0]), F.lit(max(1, math.ceil(n / SHARD)))).alias("b"), "own", "label", wide.alias("v"))

    def build(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        ids = np.full((len(own), keep), -1, dtype="<i8")
        for i, x in enumerate(own):
            ids[i, : len(x)] = x
        order = np.argsort(ids[:, 0], kind="stable")
        m = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), -1)[order]
        labels = table.column("label").to_numpy()[order]
        vantages, leaves, ways = grow(m)
        cols = [ids[order], labels.astype("<i8"), np.ascontiguousarray(m, "<f8"), vantages.astype("<f8"), leaves.astype("<i4"), ways.astype("<f8")]
        return pa.table([[table.column("b")[0].as_py()], *([c.tobytes()] for c in cols)], names=["block", *_TREE])

    return dealt.groupBy("b").applyInArrow(build, "block bigint, " + ", ".join(f"{c} binary" for c in _TREE))


_TREE = ["ids", "labels", "matrix", "vantages", "leaves", "ways"]


def _visit(anchors: DataFrame, n_anchors: int, shards: DataFrame, n: int, dims: int, keep: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, high, vec_id, score): for each window (low, high) of each row of ``anchors`` (vec_id, label, v, windows)
    the best ``k`` rows of every shard."""
    blocks = max(1, math.ceil(n_anchors / ANCHORS))
    packed = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "label", "v", "windows")).alias("rows"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            asked = row["q_rows"]
            ids = np.frombuffer(row["c_ids"], "<i8").reshape(-1, keep)
            labels = np.frombuffer(row["c_labels"], "<i8")
            m = np.frombuffer(row["c_matrix"], "<f8").reshape(len(ids), -1)
            vantages = np.frombuffer(row["c_vantages"], "<f8").reshape(-1, m.shape[1] + 1)
            leaves = np.frombuffer(row["c_leaves"], "<i4").reshape(len(vantages) + 1, -1)
            tree = Tree((m * m).sum(axis=1).max(initial=0), vantages, leaves, np.frombuffer(row["c_ways"], "<f8").reshape(len(leaves), -1, 3))
            q = np.array([x["v"] + [0.0] * (m.shape[1] - len(x["v"])) for x in asked], dtype=float).reshape(len(asked), -1)
            most = max(len(x["windows"]) for x in asked)
            windows = np.array([[(y["low"], y["high"]) for y in x["windows"]] + [(1, 0)] * (most - len(x["windows"])) for x in asked], dtype=np.int64)
            # one node more than asked for: the anchor's own may be among them
            rows, scores = traverse(tree, ids[:, 0], labels, m, q, np.array([x["label"] for x in asked]), windows, same, k + same)
            for i, x in enumerate(asked):
                for j in range(len(x["windows"])):
                    good = rows[i, j] >= 0
                    named, score = ids[rows[i, j][good]].ravel(), np.repeat(scores[i, j][good], keep)
                    fits = (named >= 0) & (named != x["vec_id"])
                    named, score = named[fits], score[fits]
                    best = np.lexsort((named, ~score))[:k]
                    for col, y in zip(cols, (np.full(len(best), x["vec_id"]), np.full(len(best), windows[i, j, 1]), named[best], score[best]), strict=True):
                        col.append(y)
        arrays = [pa.array(np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)) for c in cols]
        return pa.record_batch(arrays, names=["anchor_id", "high", "vec_id", "score"])

    found = map_batches(against(packed, shards, max(1, math.ceil(n / SHARD)), "merge"), one, "anchor_id bigint, high bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, percent: int = 80, scale: int = 256, shift: int = 7, labels: int = 10, scratch: Scratch | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose vec_id is divisible by
    ``every`` and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels that score
    at least ``percent`` hundredths of the positive and at most as much; all of them, if fewer. Ties go to the smaller vec_id.

    Scores are inner products of floor(scale * x). Where vec_id is divisible by ``shift``, the label first becomes
    (label + 1) % ``labels``. Vectors that are null or hold null or non-finite components, and rows without label or vec_id,
    take no part; of rows that repeat a vec_id the one with the smallest label and vector does. A shorter vector counts as
    padded with zeros. Scaled components beyond 1e300 are held there, scores beyond a long at its ends. An anchor without
    positives, or a positive without negatives, has no rows. Other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = scratch.save(_clean(df, scale, shift, labels), "vectors")
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    keep = max(positives + 1, negatives)
    shards = scratch.save(_shards(rows, n, dims, keep), "shards", arrow_rows=16)
    anchors = rows.where(F.col("vec_id") % every == 0)
    all_scores = F.array(F.struct(F.lit(LOWEST).cast("bigint").alias("low"), F.lit((1 << 63) - 1).cast("bigint").alias("high")))
    near = _visit(anchors.withColumn("windows", all_scores), n_anchors, shards, n, dims, keep, True, positives)
    near = scratch.save(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least whole number not below percent / 100 of a score, without overflow; a score below 0 has an empty window
    s = F.col("positive_score")
    low = F.expr("positive_score div 100") * percent + F.ceil((s % 100) * percent / 100).cast("bigint")
    per_anchor = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set(F.struct(low.alias("low"), s.alias("high"))).alias("windows"))  # at most ``positives``
    asked = anchors.join(per_anchor, anchors["vec_id"] == per_anchor["anchor_id"]).drop("anchor_id")
    far = _visit(asked, n_anchors, shards, n, dims, keep, False, negatives)
    far = far.select("anchor_id", F.col("high").alias("positive_score"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
