"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces never hold the white-space marker behind another character (checked when a model is loaded), so a
marked word - a run of markers and what follows up to the next one - is segmented the same way wherever it stands.

- Texts become *blocks* of a few megabytes: the block's distinct marked words, and for each position of its documents the
  number of the word there. Blocks are written once.
- The blocks' words meet in buckets by hash. All blocks that hold a word ask the same bucket, where the library segments
  it once for the whole corpus; a bucket answers each block with the ids of the words it asked for. Buckets follow the
  number of words asked for, so a bucket's table has a bounded size; a word that is everywhere is asked for once a block.
- A block's answers come back to it, and ids (and decoded surfaces) join its documents by position, in columns. Blocks do so
  in ``WAVES`` waves, so that shuffle files hold a fraction of the corpus at a time.

What is shuffled is a block's distinct words, their ids and the numbered positions, never a row for each word of a text.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, parts, release_memory

MARK = "▁"
BLOCK_BYTES = 16 << 20
PER_BUCKET = 200_000
WAVES = 4
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def chunks(text: str) -> list[str]:
    """The text's marked words, each without its first marker; none for an empty text."""
    if not text:
        return []
    out, pending = [], 0
    for p in text.replace(MARK, " ").split(" "):
        if p:
            out.append(" " * pending + p)
            pending = 0
        else:
            pending += 1
    if pending:
        out.append(" " * (pending - 1))
    return out


class Segmenter:
    """The library's model, checked to cut between marked words only."""

    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        probe = self.sp.encode("a  b ", out_type=str)
        if "".join(probe) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model normalises text or adds no leading marker; chunks can't be cut from raw text")
        self.eos, self.lone = self.sp.eos_id(), self.sp.piece_to_id(MARK)
        self.names = pa.array([str(i) for i in range(len(pieces))])

    def surface(self, ids: list[int]) -> str:
        """The pieces' text; bytes of runs of byte pieces are decoded together, as the library does."""
        out, run = [], bytearray()
        for i in ids:
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                run.append(int(_BYTE.match(piece)[1], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.sp.decode([i]) if self.sp.is_unknown(i) else piece.replace(MARK, " "))
        return "".join([*out, run.decode("utf-8", "replace")])

    def segment(self, words: list[str]) -> list[tuple[list[int], str | None]]:
        """Ids of each marked word, and its decoded surface where that is not the word itself behind a space."""
        found = []
        for word, ids in zip(words, self.sp.encode(words, num_threads=1), strict=True):
            ids = ids or [self.lone]
            surface = self.surface(ids)
            found.append((ids, None if surface == f" {word}" else surface))
        return found


@cache
def segmenter(model_file: str) -> Segmenter:
    return Segmenter(model_file)


def _zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as planes of bytes, compressed: the high planes are nearly all zeros."""
    return _zipped(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzipped(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _words(data: bytes) -> list[str]:
    return _unzipped(data).decode().split(MARK)


def _dealt(words: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that a block's words belong to, and the numbers of the words that belong there."""
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        yield int(bucket[places[0]]), places


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_ids, sizes, codes, n_words, words, block, wave) for each block: its documents, how many marked words each has, the
    words' numbers in order, and the distinct words by number, joined by the marker, which no word holds."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.replace_substring(pc.fill_null(batch.column(1), ""), MARK, " ")
        cut = pc.split_pattern(texts, " ")
        # runs of spaces, and spaces at either end, belong to words; most texts have none
        plain = pc.and_not(pc.not_equal(texts, ""), pc.match_substring_regex(texts, "  |^ | $"))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            where = np.arange(len(texts))
            where[odd] = len(texts) + np.arange(len(odd))
            apart = pa.array([chunks(t) for t in texts.take(pa.array(odd)).to_pylist()], cut.type)
            cut = pa.concat_arrays([cut, apart]).take(pa.array(where))
        sizes = pc.list_value_length(cut)
        coded = cut.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words have small numbers
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        joined = _zipped(MARK.join(words[i] for i in order).encode())
        row = [[batch.column(0).to_pylist()], [sizes.to_pylist()], [_squeezed(number[codes])], [len(words)], [joined]]
        types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["doc_ids", "sizes", "codes", "n_words", "words"])

    rows = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), one, "doc_ids array<bigint>, sizes array<int>, codes binary, n_words bigint, words binary", most=BLOCK_BYTES)
    return rows.withColumn("block", F.monotonically_increasing_id()).withColumn("wave", F.pmod(F.hash("block"), F.lit(WAVES)))


def asked(stored: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, wave, words): the words for which each block asks each bucket."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        for block, wave, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _words(joined)
            rows += [(bucket, block, wave, _zipped(MARK.join([words[i] for i in places]).encode())) for bucket, places in _dealt(words, buckets)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "wave", "words"])

    return map_batches(stored.where("n_words > 0").select("block", "wave", "words"), one, "bucket bigint, block bigint, wave int, words binary")


def answered(pages: DataFrame, buckets: int, model_file: str) -> DataFrame:
    """(bucket, block, wave, counts, ids, odd): for each page of words the number of ids of each, all ids, and the surfaces that
    are not the word. A task reads its buckets one after another and holds the words of one."""
    tasks = max(min(buckets, 4 * pages.sparkSession.sparkContext.defaultParallelism), math.ceil(buckets / 16))
    dealt = pages.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("at", pa.int64()), ("surface", pa.string())]))]
    names = ["bucket", "block", "wave", "counts", "ids", "odd"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, current = segmenter(model_file), {}, None
        for batch in batches:
            for part in parts(batch):
                rows = []
                for bucket, block, wave, joined in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bucket != current:
                        table, current = {}, bucket
                    words = _words(joined)
                    new = [w for w in words if w not in table]
                    table.update((w, (np.array(ids, "<u4").tobytes(), len(ids), surface)) for w, (ids, surface) in zip(new, model.segment(new), strict=True))
                    ids, counts, surfaces = zip(*map(table.__getitem__, words), strict=True)
                    odd = [{"at": i, "surface": s} for i, s in enumerate(surfaces) if s is not None]
                    rows.append((bucket, block, wave, _squeezed(np.array(counts)), _squeezed(np.frombuffer(b"".join(ids), "<u4")), odd))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        release_memory()

    return dealt.mapInArrow(answer, "bucket bigint, block bigint, wave int, counts binary, ids binary, odd array<struct<at:bigint,surface:string>>")


def encode_decode(docs: DataFrame, model_file: str, ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs`` (doc_id, text), and with ``ids`` also the ids
    (array<int>) and the decoded text; already computed. The end id is added and counts. A null text is an empty one: the
    end id alone, which decodes to nothing. Repeated rows are encoded alike; doc_id is carried as it is, null too; other
    columns are not read; an empty table gives no rows. ``model_file`` must be there on every executor."""
    scratch = scratch or Scratch(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    stored = scratch.save(blocks(docs), "blocks", by="wave")
    words = stored.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(math.ceil(words / PER_BUCKET), min(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(words / 1000)), 1)
    answers = scratch.save(answered(asked(stored, buckets), buckets, model_file), "answers", by="wave")

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = segmenter(model_file)
        doc_ids, sizes, codes, n_words, words, answers = (c[0].as_py() for c in batch.columns)
        words = _words(words) if n_words else []
        by_bucket = {a["bucket"]: a for a in answers or []}
        met = [(places, by_bucket[b]) for b, places in _dealt(words, buckets)] if n_words else []
        surfaces = [f" {w}" for w in words]
        for places, a in met:
            for x in a["odd"]:
                surfaces[places[x["at"]]] = x["surface"]
        none = [np.zeros(0, np.int64)]
        order = pa.array(np.argsort(np.concatenate([p for p, _ in met] or none)))  # from the answers' order to the words'
        counts = np.concatenate([_opened(a["counts"]) for _, a in met] or none)
        flat = np.concatenate([_opened(a["ids"]) for _, a in met] or none)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        own = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        at = pa.array(_opened(codes))
        texts = lambda values, by: pc.binary_join(pa.ListArray.from_arrays(ends, values.take(at)), by).to_pylist()
        id_texts = texts(pc.binary_join(pa.ListArray.from_arrays(own, model.names.take(pa.array(flat))), " ").take(order), " ")
        decoded = texts(pa.array(surfaces, pa.string()), "")
        running = np.concatenate([[0], np.cumsum(pa.array(counts).take(order).take(at).to_numpy())])
        tokens = np.diff(running[ends.to_numpy()]) + 1
        id_texts = [f"{t} {model.eos}" if t else str(model.eos) for t in id_texts]
        decoded = [t[1:] if t[:1] == " " else t for t in decoded]
        digest = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
        cols = [pa.array(doc_ids, pa.int64()), pa.array(tokens, pa.int64()), digest(id_texts), digest(decoded)]
        if ids:
            cols += [pa.array([list(map(int, t.split())) for t in id_texts], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return pa.record_batch(cols, names=names)

    done = []
    for wave in range(WAVES):  # what a wave shuffles goes before the next one starts
        back = answers.where(F.col("wave") == wave).groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "ids", "odd")).alias("answers"))  # a block's words, once each
        met = stored.where(F.col("wave") == wave).join(back, "block", "left").select("doc_ids", "sizes", "codes", "n_words", "words", "answers")
        done.append(scratch.save(map_batches(met, joined, schema, most=0), "pieces", arrow_rows=2))
    scratch.drop(stored, answers)
    return reduce(DataFrame.unionAll, done)
