"""Training-order materialisation of token ids.

Documents are dealt to groups by hash of their ids; in the order of ids, a group's documents - each with the end id behind
it - make one stream, cut into sequences of ``length`` tokens. Every sequence gets a dense number and, through a keyed
Feistel permutation of the range of numbers with cycle-walking, a global slot: a pseudo-random order that any reader can
compute back, without a sort by random keys. Neither numbers nor slots depend on how the input was split. Shards hold ranges
of slots in records of a fixed stride, so slot s lies at a known place of a known file and reading can resume anywhere.

Record: number of tokens (4 bytes), 1 where the doc_id is null (4), the first token's doc_id (8) and its place in that
document (8), then ``length`` ids of 2 bytes (4, for larger vocabularies), little-endian, zeros behind the last.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import Scratch, open_path, parts, qualified, release_memory, scratch_path

LENGTH = 512
PER_SHARD = 8192
PER_GROUP = 4096
ROUNDS = 4
STEPS = 4096
END_ID = 50256
HEAD = "<IIqq"
HEAD_BYTES = struct.calcsize(HEAD)
BUNDLE_BYTES = 16 << 20


def permuted(n: Column, size: int, key: int, rounds: int = ROUNDS) -> Column:
    """The slot of number n in 0..size-1, in built-in expressions: a balanced Feistel network over the smallest even
    number of bits that holds ``size``; results outside the range are walked on along their cycle to its end."""
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        for i in range(rounds):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key), F.lit(i)).bitwiseAND(mask))
        return F.shiftleft(left, half).bitwiseOR(right)

    def walked(x: Column, steps: int) -> Column:
        # lists nest where there are very many steps, and an inner list is only made for a row that is still outside
        inner = -(-steps // STEPS)
        outside = F.when(x < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(min(steps, STEPS))))
        return F.aggregate(outside, x, lambda acc, _: F.when(acc < size, acc).otherwise(once(acc) if steps <= STEPS else walked(acc, inner)))

    # a cycle has each number beyond the range once at most, so that many steps are enough. Nearly every row needs few
    first = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(n.cast("bigint")), lambda acc, _: F.when(acc < size, acc).otherwise(once(acc)))
    return F.aggregate(F.array(F.lit(0)), first, lambda acc, _: F.when(acc < size, acc).otherwise(walked(acc, (1 << 2 * half) - size)))


def sequences(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, length: int = LENGTH, end_id: int = END_ID, per_group: int = PER_GROUP) -> DataFrame:
    """(group, place, doc_id, start, n_tokens, doc_ids, ids): a group's sequences by ``place``, each with its first token's
    document and place there, the documents in it, and its ids, little-endian. The one shuffle of texts deals out groups of
    about ``per_group`` documents; a group is read as a stream."""
    groups = max(1, math.ceil(docs.count() / per_group))
    tasks = max(min(groups, 4 * docs.sparkSession.sparkContext.defaultParallelism), math.ceil(groups / 16))
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "doc_id", "text")
    dealt = mine.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_file, ranks_file)
        width = np.dtype("<u2" if bpe.exact.get_vocab_size() <= 1 << 16 else "<u4")
        group, place, tail, spans = None, 0, np.zeros(0, width), []  # spans: (doc_id, place in it) by place in the tail

        def filled(rows: list, whole: bool) -> None:
            nonlocal place, tail, spans
            at = 0
            while len(tail) - at >= length or (whole and at < len(tail)):
                stop = min(at + length, len(tail))
                i = max(j for j, (_, _, begin) in enumerate(spans) if begin <= at)
                doc, start, begin = spans[i]
                held = [d for d, _, b in spans[i:] if b < stop]
                rows.append((group, place, doc, start + at - begin, stop - at, held, tail[at:stop].tobytes()))
                place, at, spans = place + 1, stop, spans[i:]
            tail, spans = tail[at:], [(d, s, b - at) for d, s, b in spans]
            while len(spans) > 1 and spans[1][2] <= 0:
                spans.pop(0)

        def batch_of(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["group", "place", "doc_id", "start", "n_tokens", "doc_ids", "ids"])

        for batch in batches:
            for part in parts(batch):
                rows: list = []
                for g, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if g != group:
                        filled(rows, True)
                        group, place, tail, spans = g, 0, np.zeros(0, width), []
                    spans.append((doc, 0, len(tail)))
                    tail = np.concatenate([tail, np.append(bpe.encode(text), np.uint32(end_id)).astype(width)])
                    if len(tail) >= length:
                        filled(rows, False)
                if rows:
                    yield batch_of(rows)
        rows = []
        filled(rows, True)
        if rows:
            yield batch_of(rows)
        release_memory()

    return dealt.mapInArrow(cut, "group bigint, place bigint, doc_id bigint, start bigint, n_tokens int, doc_ids array<bigint>, ids binary")


def numbered(stored: DataFrame) -> DataFrame:
    """``stored`` with ``number`` (0, 1, ... without gaps) in order of group and place. Ids stay where they are; what is counted
    and broadcast has a row for each group."""
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("group").agg(F.count("*").alias("c")).select("group", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    return stored.join(F.broadcast(starts), "group").withColumn("number", F.col("first") + F.col("place")).drop("first", "group", "place")


def shard_name(i: int) -> str:
    return f"shard-{i:08d}.bin"


def materialise(docs: DataFrame, path: str, tokenizer_file: str, ranks_file: str | None = None, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards and ``layout.json`` under ``path`` and returns a row per sequence (slot, shard, offset, doc_id, start,
    n_tokens, doc_ids, ids_crc32), already computed.

    Each document ends with the end id, so a null or empty text gives that id alone. Null doc_ids stay null, in records too.
    Rows that repeat a doc_id are all written, in order of their texts. No documents give no shards.
    """
    spark = docs.sparkSession
    scratch, path = scratch or Scratch(spark), qualified(spark, path)
    stored = scratch.save(sequences(docs, tokenizer_file, ranks_file, length, end_id), "sequences")
    total = stored.count()
    size = 2 if byte_bpe(tokenizer_file, ranks_file).exact.get_vocab_size() <= 1 << 16 else 4
    stride = HEAD_BYTES + size * length
    placed = numbered(stored).select(permuted(F.col("number"), max(total, 1), key).alias("slot"), "doc_id", "start", "n_tokens", "doc_ids", "ids")
    tasks = max(1, math.ceil(total / per_shard))  # a task writes one shard, and holds it
    job = uuid.uuid4().hex
    columns = ["slot", "doc_id", "start", "n_tokens", "doc_ids", "ids"]

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sequences for one shard travel as one compressed Arrow batch."""
        zstd, held, size = zstandard.ZstdCompressor(level=3), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table.column("slot").to_numpy() // per_shard
            order = np.argsort(shard, kind="stable")
            table, shard = table.take(order), shard[order]
            for begin, end in zip(starts := np.nonzero(np.diff(shard, prepend=-1))[0], [*starts[1:], len(shard)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table.slice(begin, end - begin))
                yield pa.record_batch([pa.array([shard[begin]], pa.int32()), pa.array([zstd.compress(sink.getvalue())], pa.binary())], names=["shard", "bundle"])

        for batch in batches:
            for part in parts(batch):
                held.append(part)
                size += part.nbytes
                if size >= BUNDLE_BYTES:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()
        release_memory()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for shard, bundle in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(bundle.as_buffer())
                tables.setdefault(shard, []).append(pa.ipc.open_stream(raw).read_all())
        system, root = open_path(path)
        for shard in sorted(tables):
            table = pa.concat_tables(tables.pop(shard)).sort_by("slot").combine_chunks()
            slots = table.column("slot").to_numpy()
            if (slots != np.arange(shard * per_shard, min((shard + 1) * per_shard, total))).any():
                raise ValueError(f"shard {shard} lacks slots")
            hidden = f"{root}/_{job}-{uuid.uuid4().hex}"
            system.create_dir(root, recursive=True)
            crc = []
            with system.open_output_stream(hidden, compression=None) as out:
                for doc, start, n, ids in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "ids")), strict=True):
                    out.write(struct.pack(HEAD, n, doc is None, 0 if doc is None else doc, start) + ids.ljust(size * length, b"\0"))
                    crc.append(zlib.crc32(ids))
            system.move(hidden, f"{root}/{shard_name(shard)}")
            done = table.drop_columns(["ids"]).append_column("shard", pa.array(np.full(len(slots), shard))).append_column("offset", pa.array(slots % per_shard * stride)).append_column("ids_crc32", pa.array(crc, pa.int64()))
            yield from done.select(names).combine_chunks().to_batches()
        release_memory()

    names = ["slot", "shard", "offset", "doc_id", "start", "n_tokens", "doc_ids", "ids_crc32"]
    bundles = placed.select(*columns).mapInArrow(bundled, "shard int, bundle binary")
    done = scratch.save(bundles.repartitionById(tasks, "shard").mapInArrow(write, "slot bigint, shard bigint, offset bigint, doc_id bigint, start bigint, n_tokens int, doc_ids array<bigint>, ids_crc32 bigint"), "slots")
    scratch.drop(stored)
    system, root = open_path(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/layout.json", compression=None) as f:
        f.write(json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "stride": stride, "id_bytes": size, "key": key}).encode())
    return done


def _record(record: bytes, id_bytes: int) -> tuple[int | None, int, int, bytes]:
    """doc_id, start, number of tokens, ids."""
    n, null, doc, start = struct.unpack_from(HEAD, record)
    return None if null else doc, start, n, record[HEAD_BYTES : HEAD_BYTES + n * id_bytes]


def read_slots(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, start, ids) in training order from slot ``start`` on: sequential reads that resume anywhere."""
    system, root = open_path(path)
    with system.open_input_file(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    stride, per = layout["stride"], layout["per_shard"]
    stop = min(layout["sequences"], layout["sequences"] if stop is None else stop)
    slot = start
    while slot < stop:
        with system.open_input_file(f"{root}/{shard_name(slot // per)}") as f:
            f.seek(slot % per * stride)
            while slot < stop:
                doc, begin, _, ids = _record(f.read(stride), layout["id_bytes"])
                yield slot, doc, begin, np.frombuffer(ids, dtype=f"<u{layout['id_bytes']}")
                slot += 1
                if slot % per == 0:
                    break


def read_back(slots: DataFrame, path: str) -> DataFrame:
    """The rows of ``slots`` (slot, shard, offset, doc_ids) as their shards hold them: with doc_id, start, n_tokens and
    ids_crc32, read in Spark, one seek a record where they are not sequential."""
    path = qualified(slots.sparkSession, path)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(path)
        with system.open_input_file(f"{root}/layout.json") as f:
            layout = json.loads(f.read())
        f, current = None, None
        for batch in batches:
            rows: list = []
            for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != current:
                    if f is not None:
                        f.close()
                    f, current = system.open_input_file(f"{root}/{shard_name(shard)}"), shard
                if f.tell() != offset:
                    f.seek(offset)
                doc, start, n, ids = _record(f.read(layout["stride"]), layout["id_bytes"])
                rows.append((doc, start, n, zlib.crc32(ids)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["slot", "shard", "offset", "doc_ids", "doc_id", "start", "n_tokens", "ids_crc32"])
        if f is not None:
            f.close()

    return slots.select("slot", "shard", "offset", "doc_ids").mapInArrow(one, "slot bigint, shard bigint, offset bigint, doc_ids array<bigint>, doc_id bigint, start bigint, n_tokens int, ids_crc32 bigint")


def training_order(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, path: str | None = None, **options) -> DataFrame:
    """Materialises ``docs`` and returns its sequences as read back from the shards."""
    path = path or scratch_path(docs.sparkSession, "shards")
    return read_back(materialise(docs, path, tokenizer_file, ranks_file, **options), path)
