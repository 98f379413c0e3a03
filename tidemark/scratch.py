"""Tables that a plan has to hold still: written once to the folder that the cluster shares, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_alone: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder stands in for it on a single machine; a cluster is refused.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _alone.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


@contextmanager
def set_conf(spark: SparkSession, **values: str):
    """Session settings for the actions inside; names are written with ``__`` for dots."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def held(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as written to the shared folder: later readings see the same rows, whatever executors are lost. The shuffle
    files that made it go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
    with set_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
