"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

1. A document's set of shingles (five words, hashed to 64 bits) gives its sketch: the k smallest hashes. Documents with
   equal sets form a class; only one representative per class goes on.
2. Retained values become inverted lists. Two sets with Jaccard 0.75 share at least ``min_overlap`` of k = 48 retained
   values but for a chance below 1e-6 at the threshold itself, and far below above it. So it is enough to look up the
   rarest retained values of a sketch (all but ``min_overlap - 1`` of them): values of a passage that very many documents
   share drop out wherever the document has anything of its own.
3. Members are compared with the smallest member of their lists: first each with the smallest of all, then, where that left
   them apart, with the others. Pairs whose union-sketch estimate is possible are verified by exact Jaccard on the full
   sets.
4. Lists whose other members still lie in several components are compared in full: members with their sets are dealt to
   blocks, a component's members to blocks of their own, and pairs of blocks are compared as matrices inside a task - by
   sketch, then by whole set. What leaves a task is a spanning forest of the links it found, never all pairs of a group;
   those links are verified on the full sets like the others.
5. Connected components of the verified links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_by_ids, fresh, map_batches
from .components import connected_components

SHINGLE = 5
SKETCH = 48
MIN_OVERLAP = 19
PERCENT = 75
BLOCK = 256
BLOCK_BYTES = 2 << 20
COLUMNS = 4096
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    """Hashes of the words met so far by this worker; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: five words, or all of them where there are fewer; none for a
    null, empty or blank text. Words lie between ASCII white space; A-Z are lower-cased, nothing else."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _MULT[i]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """(doc_id, n, set_id, sketch): set size, a 128-bit digest of the set (null if empty), its k smallest hashes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n", "set_id", "sketch"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), one, "doc_id bigint, n bigint, set_id binary, sketch array<bigint>", _words.clear)


def _possible(na, nb, sa, sb, k: int, least: int):
    """Whether the sketches of two sets allow the threshold: exact where both hold their whole sets, else by the share of
    the union's k smallest hashes that both retain."""
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(sa, sb), union))
    whole = F.size(F.array_intersect(sa, sb))
    size_ok = F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT
    return size_ok & F.when((na <= k) & (nb <= k), whole * 100 >= (na + nb - whole) * PERCENT).otherwise(both * k >= least * F.size(union))


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, k: int, least: int) -> DataFrame:
    """Of pairs (a, b) that the sketches allow, those with an exact Jaccard at the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    likely = scratch.save(
        pairs.join(side("a"), "a").join(side("b"), "b").where(_possible(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), k, least)).select("a", "b"),
        "likely",
    )
    ids = likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct()
    texts = filter_by_ids(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), "rep", ids)
    texts = scratch.save(texts.join(ids, "rep", "left_semi"), "texts")

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[int, np.ndarray] = {}
        good, held = [], 0
        for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if a not in sets:
                if held > BLOCK_BYTES:
                    sets.clear()
                    held = 0
                sets[a] = shingle_set(ta)
                held += sets[a].nbytes
            x, y = sets[a], shingle_set(tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_a = likely.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    joined = with_a.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = scratch.save(map_batches(joined, exact, "a bigint, b bigint", _words.clear), "links")
    scratch.drop(texts, likely)
    return links


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of those pairs that join two parts not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            out.append(i)
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, counted over ``COLUMNS`` shared values at a time."""
    out = np.zeros((len(left), len(right)))
    sides = [np.concatenate(x) for x in ((left,) if left is right else (left, right))]
    if left is right:
        distinct, times = np.unique(sides[0], return_counts=True)
        shared = distinct[times > 1]
    else:
        shared = np.intersect1d(*sides)
    held = []
    for sets, values in zip((left, right), sides, strict=False):
        at = np.searchsorted(shared, values)
        hit = np.nonzero(shared[np.minimum(at, len(shared) - 1)] == values)[0] if len(shared) else np.zeros(0, np.int64)
        rows, at = np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))[hit], at[hit]
        order = np.argsort(at, kind="stable")
        held.append((rows[order], at[order], len(sets)))
    for first in range(0, len(shared), COLUMNS):
        has = []
        for rows, at, n in held:
            span = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            m = np.zeros((n, min(COLUMNS, len(shared) - first)), dtype=np.float32)
            m[rows[span], at[span] - first] = 1
            has.append(m)
        out += has[0] @ has[-1].T
    return out


Block = tuple[np.ndarray, np.ndarray, list[np.ndarray]]  # ids, components, sets: sorted, so the first k are the sketch


def _block_links(left: Block, right: Block | None, k: int, least: int) -> list[tuple[int, int]]:
    """Links between members of different components in a block, or between two blocks: a spanning forest of them."""
    right = right or left
    size_a, size_b = (np.array(list(map(len, x[2]))) for x in (left, right))
    low, high = np.minimum.outer(size_a, size_b), np.maximum.outer(size_a, size_b)
    open_ = np.not_equal.outer(left[1], right[1]) & (100 * low >= PERCENT * high)
    if not open_.any():
        return []
    # a sketch of a whole set shows the intersection itself; others retain ``least`` common values at the threshold
    heads = [x[:k] for x in left[2]]
    seen = _overlaps(heads, heads if right is left else [x[:k] for x in right[2]])
    open_ &= seen >= np.where(high <= k, np.ceil(low * PERCENT / 100), np.minimum(least, np.ceil(low * PERCENT / 100)))
    if not open_.any():
        return []
    own, other = np.nonzero(open_.any(axis=1))[0], np.nonzero(open_.any(axis=0))[0]
    both = _overlaps([left[2][i] for i in own], [right[2][i] for i in other])
    over = 100 * both >= PERCENT * (size_a[own][:, None] + size_b[other] - both)
    a, b = np.nonzero(open_[np.ix_(own, other)] & over)
    a, b = own[a], other[b]
    forest = _forest(left[1][a], right[1][b])
    x, y = left[0][a[forest]], right[0][b[forest]]
    return list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))


def _unpacked(rows: pa.ListScalar) -> Block | None:
    if not rows.is_valid:
        return None
    ids, comps, hashes = rows.values.flatten()
    return ids.to_numpy(), comps.to_numpy(), [np.frombuffer(h, dtype="<i8") for h in hashes.to_pylist()]


def _cross_links(lists: DataFrame, heads: DataFrame, comps: DataFrame, docs: DataFrame, scratch: Scratch, k: int, least: int) -> DataFrame:
    """Links (a, b) between different components within a list, heads left out: a spanning forest for each pair of blocks."""
    held = lists.join(heads.select("value", F.col("a").alias("head")), "value").where("rep <> head").select("value", "rep", "n")
    held = held.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    open_lists = (
        held.groupBy("value")
        .agg(F.count("*").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi")
        .groupBy("members", "sign")  # lists of the same members give the same links
        .agg(F.min("value").alias("value"))
    )
    held = scratch.save(held.join(open_lists.select("value"), "value"), "members")
    ids = held.select("rep").distinct()
    texts = filter_by_ids(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), "rep", ids).join(ids, "rep", "left_semi")
    texts = scratch.save(texts, "texts")  # else a task would hold two Python workers

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([shingle_set(t).astype("<i8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["rep", "hashes"])

    sets = scratch.save(map_batches(texts, whole, "rep bigint, hashes binary", _words.clear).distinct(), "sets")
    # components that would fill a block get blocks of their own: two of those need no comparison
    size = [F.count("*").alias("c"), F.sum(F.col("n") * 8).alias("bytes")]
    pools = held.groupBy("value", "comp").agg(*size).withColumn("pool", F.when((F.col("c") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES), F.col("comp")))
    counts = pools.groupBy(F.col("value").alias("v"), F.col("pool").alias("p")).agg(F.greatest(F.ceil(F.sum("c") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    own = pools.where("pool IS NOT NULL").select("value", "comp", "pool")
    dealt = held.join(own, ["value", "comp"], "left").join(counts, (F.col("value") == F.col("v")) & F.col("pool").eqNullSafe(F.col("p")))
    dealt = dealt.withColumn("place", F.concat_ws(":", F.coalesce(F.col("pool").cast("string"), F.lit("")), F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    blocks = scratch.save(dealt.join(sets, "rep").groupBy("value", "pool", "place").agg(F.collect_list(F.struct("rep", "comp", "hashes")).alias("rows")), "blocks")
    # pairs of blocks are pairs of numbers; each side's rows are fetched by list and number
    numbers = blocks.select("value", "pool", "place")
    other = numbers.select("value", F.col("pool").alias("q"), F.col("place").alias("j"))
    pairs = scratch.save(numbers.join(other, "value").where("place < j AND NOT (pool IS NOT NULL AND pool <=> q)").select("value", F.col("place").alias("i"), "j"), "pairs")
    x, y = (blocks.select("value", F.col("place").alias(n), F.col("rows").alias(r)) for n, r in (("i", "x"), ("j", "y")))
    both = pairs.join(x, ["value", "i"]).join(y, ["value", "j"]).select("x", "y")
    alone = blocks.where("pool IS NULL").select(F.col("rows").alias("x"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("y"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {p for x, y in zip(batch.column(0), batch.column(1), strict=True) for p in _block_links(_unpacked(x), _unpacked(y), k, least)}
        return pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    found = scratch.save(map_batches(alone.union(both), compare, "a bigint, b bigint").distinct(), "cross", arrow_rows=4)
    scratch.drop(blocks, pairs, sets, texts, held)
    return found


def near_duplicates(docs: DataFrame, k: int = SKETCH, min_overlap: int = MIN_OVERLAP, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked if the Jaccard similarity of their shingle sets is 0.75 or more; component_id is the smallest
    doc_id reachable by links, itself included; kept marks the document that has it. Null, empty and blank texts have
    no shingles and are linked with nothing. Rows that repeat a doc_id count as one document that has the links of each
    of its texts. A row without doc_id takes no part: its component_id is null and it is kept. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    every = scratch.save(sketches(docs, k), "sketches")
    classes = scratch.save(
        every.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m"))
        .select("set_id", F.col("m.doc_id").alias("rep"), "m.n", "m.sketch"),
        "classes",
    )
    tokens = classes.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    common = tokens.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    need = F.least(F.lit(min_overlap), F.ceil(F.col("m") * PERCENT / 100).cast("int"))
    lists = scratch.save(
        tokens.join(common, "value")
        .groupBy("rep", "m", "n")
        .agg(F.collect_list(F.struct("df", "value")).alias("shared"))
        .withColumn("need", need)
        .where(F.size("shared") >= F.col("need"))
        .select("rep", "n", F.explode(F.slice(F.array_sort("shared"), F.lit(1), F.size("shared") - F.col("need") + 1)).alias("v"))
        .select("rep", "n", F.col("v.value").alias("value"))
        .distinct(),
        "lists",
    )
    heads = lists.groupBy("value").agg(F.count("*").alias("members"), F.min("rep").alias("a")).where("members > 1")
    tried = scratch.save(lists.join(heads, "value").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "heads")
    links = _verify(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), classes, docs, scratch, k, min_overlap)
    comps = scratch.save(connected_components(links, scratch), "components")
    other = tried.join(tried.groupBy("b").agg(F.min("a").alias("a")), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        other = other.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    other = scratch.save(other.where("ca <> cb").select("a", "b"), "other_heads")
    links = links.union(_verify(other, classes, docs, scratch, k, min_overlap))
    comps = scratch.save(connected_components(links, scratch), "components")
    cross = _cross_links(lists, heads, comps, docs, scratch, k, min_overlap)
    if not cross.isEmpty():
        links = links.union(_verify(cross, classes, docs, scratch, k, min_overlap))
        comps = scratch.save(connected_components(links, scratch), "components")
    scratch.drop(lists, tried, other, cross)
    label = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("label"))
    # equal sets that lie far apart: the class joins back by its digest; rows without one keep their own id
    out = every.join(label, "set_id", "left").withColumn("component_id", F.coalesce("label", "doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component, the row of its smallest doc_id. All columns stay.
    Of rows that repeat a doc_id all stay."""
    name = fresh(docs, "lost")
    lost = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, docs["doc_id"].cast("bigint") == F.col(name), "left_anti")
