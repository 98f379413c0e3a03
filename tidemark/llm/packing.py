"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths (its length written
in base two, the longest allowed piece repeated first). Pieces of one length form a bucket; each piece is a sequence of
its own, so no sequence crosses documents and none needs padding."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import Scratch, map_batches
from .numbering import number_rows

MAX_LENGTH = 2048
END_ID = 1
PER_GROUP = 8192


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two, longest first, that sum to n; none exceeds ``most``, itself a power of two."""
    return [most] * (n // most) + [b for b in (1 << i for i in reversed(range(most.bit_length() - 1))) if n % most & b]


def pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, most: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) for each piece."""
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(tokenizer_file, ranks_file)
        rows, held = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = np.append(bpe.encode(text), np.uint32(end_id)).astype(np.int32)
            held.append(tokens)
            at = 0
            for n in binary_lengths(len(tokens), most):
                rows.append((doc, at, n, len(tokens)))
                at += n
        # pieces follow each other as the ids do
        ends = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), ids], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), one, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids array<int>")


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, most: int = MAX_LENGTH, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) with ``sequence_id`` and ``offset``. Sequences are numbered bucket by
    bucket, longest first, so a bucket is one range of ids; offset is 0, as each holds one piece. A null text is empty: the
    end id alone. Rows that repeat a doc_id are packed each on their own; doc_id may be null; other columns are not read; an
    empty table gives no rows."""
    scratch = scratch or Scratch(docs.sparkSession)
    stored = scratch.save(pieces(docs, tokenizer_file, ranks_file, most, end_id), "pieces")
    groups = max(1, math.ceil(stored.count() / PER_GROUP))
    return number_rows(stored, "length", ["doc_id", "start", "doc_tokens"], "sequence_id", groups).withColumn("offset", F.lit(0).cast("bigint"))


def with_crc(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32``, of the ids as little-endian unsigned 32-bit numbers, instead of the ids."""
    at = packed.columns.index("ids")
    others = [c for c in packed.columns if c != "ids"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(at)
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.record_batch([*(batch.column(c) for c in others), pa.array(crc, pa.int64())], names=[*others, "ids_crc32"])

    return map_batches(packed, one, ", ".join(f"{c} bigint" for c in [*others, "ids_crc32"]))
