"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document, weight times saturated frequency, is a whole number. Documents are cut into blocks of at most
2,048. In a block, each term has a bitmap of its documents for every bit of the impact; the index keeps these slices over the
term's own postings, and they are spread to the block's documents when read. A block answers all items of a query block in
step: the slices of each item's next term are added to the item's sum slices, least significant first, by bitwise carries
(sum = a ^ b ^ c, carry = ab | c(a ^ b)), 64 documents to a machine word. The k best are found from the most significant
slice down: documents with the bit set come before those without, until k are told apart; ties at the k-th place go to the
smaller id. Blocks' results meet in a limited window.

Postings are gathered where the documents are read; what is shuffled is a row for each term of a block.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against
from .common import Scratch, hash_bitmap, map_batches, parts, release_memory

DOCS = 2048
POSTINGS = 1 << 20
ITEMS = 64
TERMS_AT_ONCE = 2048
LONG = 63

#: Bytes of terms stay, with A-Z lower-cased; the others become blanks.
_TO_TERMS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, in UTF-8, A-Z lower-cased and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def _postings(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, term, n, total, ids, places, counts): for each term of ``wanted`` in a block, how many of its documents hold it,
    where and how often; with a null term, the block's documents that have terms, by id, with their numbers of terms.
    ``wanted`` prunes by hash here, to 2 MB of bits whatever its size; a join on it must follow. A block is a matter of the
    task that reads its documents, and is written once."""
    bitmap, bits = hash_bitmap(wanted, "term")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap.value, dtype=np.uint8)
        known: dict[bytes, bool] = {}
        ids: list[int | None] = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        size = 0

        def passes(term: bytes) -> bool:
            if (answer := known.get(term)) is None:
                if len(known) > 200_000:
                    known.clear()
                h = xxhash.xxh64_intdigest(term, 42) & ((1 << bits) - 1)  # as Spark's xxhash64
                answer = known[term] = bool(held[h >> 3] >> (h & 7) & 1)
            return answer

        def block() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().int >> 65
            rows = [(name, None, len(ids), sum(lengths), ids, b"", np.array(lengths, "<i8").tobytes())]
            rows += [(name, t, len(p), sum(c), None, np.array(p, "<u2").tobytes(), np.array(c, "<i8").tobytes()) for t, (p, c) in lists.items()]
            for at in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + 4096], strict=True), _POSTING_TYPES, strict=True)], names=_POSTING_NAMES)
            ids.clear(), lengths.clear(), lists.clear()

        try:
            for batch in batches:
                for part in parts(batch):
                    for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        found = terms_of(text)
                        for term, n in Counter(found).items():
                            if passes(term):
                                places, counts = lists.setdefault(term, ([], []))
                                places.append(len(ids))
                                counts.append(n)
                                size += 1
                        if found:
                            ids.append(doc_id)
                            lengths.append(len(found))
                        if len(ids) == DOCS or size >= POSTINGS:
                            yield from block()
                            size = 0
            if ids:
                yield from block()
        finally:
            release_memory()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(gather, "block bigint, term binary, n bigint, total bigint, ids array<bigint>, places binary, counts binary"), "postings")


_POSTING_NAMES = ["block", "term", "n", "total", "ids", "places", "counts"]
_POSTING_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def build_index(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The index (block, ids, terms, starts, places, width, slices) of the terms in the one column ``term`` of ``terms``, a
    row for each block, and the number of blocks. All statistics are over all rows of ``docs``."""
    postings = _postings(docs, terms, scratch)
    n_docs, n_terms, n_blocks = postings.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("n") + 1))).cast("bigint")
    lists = postings.where("term IS NOT NULL")
    weights = lists.groupBy("term").agg(weight.alias("weight")).where("weight > 0").join(terms, "term", "left_semi")
    rows = lists.join(weights, "term").unionByName(postings.where("term IS NULL").withColumn("weight", F.lit(0).cast("bigint")))

    def build(table: pa.Table) -> pa.Table:
        term, weight, places, counts = (table.column(c).to_pylist() for c in ("term", "weight", "places", "counts"))
        head = term.index(None)
        lengths = np.frombuffer(counts[head], dtype="<i8").tolist()
        m = np.array([10 + (90 * n * n_docs) // n_terms for n in lengths], dtype=np.int64)
        order = sorted((i for i in range(len(term)) if i != head), key=term.__getitem__)
        at, tf = (np.frombuffer(b"".join(x[i] for i in order), dtype=kind) for x, kind in ((places, "<u2"), (counts, "<i8")))
        sizes = [len(places[i]) // 2 for i in order]
        impact = np.repeat(np.array([weight[i] for i in order], dtype=np.int64), sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        width = int(impact.max(initial=0)).bit_length()
        slices = b"".join(np.packbits((impact >> b & 1).astype(bool), bitorder="little").tobytes() for b in range(width))
        cols = [table.column("block")[0].as_py(), table.column("ids")[head].as_py(), [term[i] for i in order], np.cumsum([0, *sizes]).astype("<i8").tobytes(), at.tobytes(), width, slices]
        return pa.table([pa.array([c], kind) for c, kind in zip(cols, _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)

    built = rows.groupBy("block").applyInArrow(build, "block bigint, ids array<bigint>, terms array<binary>, starts binary, places binary, width int, slices binary")
    index = scratch.save(built, "index", arrow_rows=16)
    scratch.drop(postings)
    return index, n_blocks


_INDEX_NAMES = ["block", "ids", "terms", "starts", "places", "width", "slices"]
_INDEX_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]


class Block:
    """A block of the index as it is read."""

    def __init__(self, ids: list[int | None], terms: list[bytes], starts: bytes, places: bytes, width: int, slices: bytes):
        self.ids, self.width, self.words = ids, width, (len(ids) + 63) // 64
        self.number = {t: i for i, t in enumerate(terms)}
        self.starts, self.places = np.frombuffer(starts, "<i8"), np.frombuffer(places, "<u2").astype(np.int64)
        self.slices = np.frombuffer(slices, np.uint8).reshape(width, -1) if width else np.empty((0, 0), np.uint8)

    def bitmaps(self, terms: np.ndarray) -> np.ndarray:
        """(bit, term, word): the terms' slices spread to the block's documents."""
        out = np.zeros((self.width, len(terms) * self.words), dtype=np.uint64)
        sizes = self.starts[terms + 1] - self.starts[terms]
        before = np.cumsum(sizes) - sizes
        own = np.repeat(self.starts[terms] - before, sizes) + np.arange(sizes.sum())
        places = self.places[own]
        word = np.repeat(np.arange(len(terms)) * self.words, sizes) + (places >> 6)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        one = np.uint64(1) << (places & 63).astype(np.uint64)
        for b in range(self.width):
            has = np.unpackbits(self.slices[b], bitorder="little")[own].astype(np.uint64)
            out[b, word[first]] = np.bitwise_or.reduceat(one * has, first)
        return out.reshape(self.width, len(terms), self.words)

    def sums(self, items: list[list[bytes]]) -> np.ndarray:
        """(bit, item, word): the slices of each item's scores."""
        lists = [[n for t in item if (n := self.number.get(t)) is not None] for item in items]
        bits = min(LONG, self.width + max(map(len, lists), default=0).bit_length())
        out = np.zeros((bits, len(items), self.words), dtype=np.uint64)
        used = np.unique(np.array([n for own in lists for n in own], dtype=np.int64))
        for at in range(0, len(used), TERMS_AT_ONCE):
            some = used[at : at + TERMS_AT_ONCE]
            maps = self.bitmaps(some)
            left = [[int(np.searchsorted(some, n)) for n in own if some[0] <= n <= some[-1]] for own in lists]
            for r in range(max(map(len, left))):
                going = np.array([i for i, own in enumerate(left) if len(own) > r])
                term = np.array([left[i][r] for i in going])
                carry = np.zeros((len(going), self.words), dtype=np.uint64)
                for b in range(bits):
                    a = out[b, going]
                    if b < self.width:
                        x = maps[b, term]
                        half = a ^ x
                        out[b, going] = half ^ carry
                        carry = (a & x) | (carry & half)
                    elif carry.any():
                        out[b, going] = a ^ carry
                        carry &= a
                    else:
                        break
        return out

    def top(self, sums: np.ndarray, k: int) -> list[list[tuple[int | None, int]]]:
        """For each item its k documents of the highest scores above 0, as (id, score)."""
        open_ = np.bitwise_or.reduce(sums, axis=0) if len(sums) else np.zeros(sums.shape[1:], np.uint64)
        sure = np.zeros_like(open_)
        for s in sums[::-1]:
            with_bit = sure | (open_ & s)
            count = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)[:, None]
            open_ = np.where(count > k, open_ & s, np.where(count < k, open_ & ~s, np.uint64(0)))
            sure = np.where(count > k, sure, with_bit)
        out = []
        for i in range(sums.shape[1]):
            certain, ties = (np.flatnonzero(np.unpackbits(x[i].astype("<u8").view(np.uint8), bitorder="little")).tolist() for x in (sure, open_))
            ties.sort(key=lambda p: (self.ids[p] is None, self.ids[p] or 0))
            found = []
            for p in certain + ties[: k - len(certain)]:
                score = sum(1 << b for b in range(len(sums)) if int(sums[b, i, p >> 6]) >> (p & 63) & 1)
                found.append((self.ids[p], score))
            out.append(found)
        return out


def search(index: DataFrame, n_blocks: int, items: DataFrame, n_items: int, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): ``items`` (item_id, terms) against every block of the index."""
    blocks = max(1, math.ceil(n_items / ITEMS))
    queries = items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int | None, int]] = []
        for row in batch.to_pylist():
            block = Block(*(row[f"c_{c}"] for c in _INDEX_NAMES[1:]))
            found = block.top(block.sums([x["terms"] for x in row["q_items"]]), k)
            rows += [(x["item_id"], doc_id, score) for x, own in zip(row["q_items"], found, strict=True) for doc_id, score in own]
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    found = map_batches(against(queries, index, max(1, n_blocks), "merge"), one, "item_id bigint, doc_id bigint, score bigint")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of the highest scores above 0 (all, if fewer), ties
    to the smaller doc_id.

    Null and empty texts, and texts without a term, match nothing and count in no statistic; items of that kind have no rows. Every row of ``docs`` is
    a document of its own: rows that repeat an id are ranked each, rows without one come last among ties. Items without an id
    take no part; of rows that repeat an item's id the one with the smallest text does. Other columns are not read. Scores are
    whole below 2 ** 63.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    one = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = scratch.save(map_batches(one, split, "item_id bigint, terms array<binary>"), "items")
    terms = scratch.save(asked.select(F.explode("terms").alias("term")).distinct(), "terms")
    index, n_blocks = build_index(docs, terms, scratch)
    return search(index, n_blocks, asked, asked.count(), k)
