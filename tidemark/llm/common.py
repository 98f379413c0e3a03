"""What the operators share: scratch tables in the cluster's shared folder, Arrow batches of bounded size, and an id filter."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_shared: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder stands in for it on a single machine; a cluster is refused.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_shared.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"


@contextmanager
def set_conf(spark: SparkSession, **values: str):
    """Session settings for the actions inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}".lower() in taken or f"__{name}_".lower() in taken:
        name += "_"
    return f"__{name}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system: a path without a scheme lies where Spark's default file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Scratch:
    """Writes intermediate tables to the shared folder, so that later stages neither recompute them nor depend on
    an executor that may be lost; the shuffle files that made a table go once it is written. A table can be dropped as
    soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str = "table", arrow_rows: int | None = None, by: str | None = None) -> DataFrame:
        """``arrow_rows``: most rows of an Arrow batch, for rows that are large each. ``by``: a column of few values, each of
        which lies in a folder of its own."""
        path = scratch_path(self.spark, name)
        sizes = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(arrow_rows)} if arrow_rows else {}
        with set_conf(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **sizes):
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


BATCH_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes, one row each at least."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def release_memory() -> None:
    """Gives what a task held back to the system: Python workers live on and are used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, done: Callable[[], None] | None = None, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` with a function of one batch, which gets slices of about ``most`` bytes (0: of one row each); None and
    empty results are left out. ``done`` runs at a task's end, before its memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in parts(batch, most):
                    if (out := fn(part)) is not None and out.num_rows:
                        yield out
        finally:
            if done is not None:
                done()
            release_memory()

    return df.mapInArrow(run, schema)


ID_FILTER_BITS = 24


def filter_by_ids(df: DataFrame, key: str, ids: DataFrame, bits: int = ID_FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the one column of ``ids``: never fewer than the matching rows.

    What travels to the executors is a bitmap of ``2 ** bits`` hash buckets (2 MB at 24), however many ids there are;
    with very many ids it only prunes less. A join on the ids must follow.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    name = fresh(df, "bucket")
    rows = (
        ids.select(bucket(ids[ids.columns[0]]).alias("h"))
        .groupBy(F.expr("bitmap_bucket_number(h)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m"))
        .collect()
    )  # at most 2 ** bits / 32768 rows of 4 kB
    words = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for b, m in rows:
        part = np.frombuffer(bytes(m), dtype=np.uint8)
        words[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part
    shared = df.sparkSession.sparkContext.broadcast(words.tobytes())

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64) - 1
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        return batch.filter(pa.array(((bitmap[h >> 3] >> (h & 7)) & 1).astype(bool)))

    held = df.where(F.col(key).isNotNull()).withColumn(name, bucket(F.col(key)))
    return map_batches(held, keep, held.schema).drop(name)


def hash_bitmap(keys: DataFrame, column: str, bits: int = ID_FILTER_BITS) -> tuple[Broadcast, int]:
    """A broadcast bitmap of ``2 ** bits`` buckets, 2 MB at 24, with the bit ``xxhash64(key) mod 2 ** bits`` set for each
    key, and ``bits``: with very many keys it prunes less, and never grows."""
    h = F.pmod(F.xxhash64(column), F.lit(1 << bits)) + 1
    rows = keys.select(h.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()  # 512 of 4 kB
    words = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for b, m in rows:
        part = np.frombuffer(bytes(m), dtype=np.uint8)
        words[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part
    return keys.sparkSession.sparkContext.broadcast(words.tobytes()), bits
