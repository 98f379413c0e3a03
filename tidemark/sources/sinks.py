"""One document of many rows: a file in order, written by many tasks.

A Python data source writes each partition to a part of its own, in a folder beside the target, with the separators between
rows; at commit the parts are strung together in the order of partitions, with what stands before, between and behind them,
and moved to the target. A task holds one row at a time, the commit one buffer. A task that fails removes its part, a job that
fails removes the folder, and the target appears whole or not at all.
"""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import Refused

BUFFER = 8 << 20
MOST_FIELDS = 100_000

Order = list[str | tuple[str, bool]]  # columns, the first one leading, and whether they descend


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class _DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.before, self.between, self.behind, self.none = (options.get(k, "").encode() for k in ("before", "between", "behind", "none"))
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _open(self.folder)
        path, rows = f"{folder}/part-{task.partitionId():07d}-{task.taskAttemptId()}", 0
        try:
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(path, buffer_size=1 << 20) as out:
                for row in iterator:
                    if row[0] is None:
                        raise Refused("INVALID_INPUT", "a row of a document is null", "value")
                    out.write((self.between if rows else b"") + row[0].encode("utf-8"))
                    rows += 1
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_file(path)
            raise
        return _Part(task.partitionId(), path, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        system, folder = _open(self.folder)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/whole") as out:
            out.write(self.before if parts else self.none)
            for i, part in enumerate(parts):
                out.write(self.between if i else b"")
                with system.open_input_stream(part.path) as held:
                    while block := held.read(BUFFER):
                        out.write(block)
            out.write(self.behind if parts else b"")
        system.move(f"{folder}/whole", _open(self.path)[1])
        system.delete_dir(folder)

    def abort(self, messages: list[_Part | None]) -> None:
        system, folder = _open(self.folder)
        with contextlib.suppress(OSError):
            system.delete_dir(folder)


class _Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options)


def write_document(rows: DataFrame, order: Order, value: str, path: str, before: str = "", between: str = "", behind: str = "", none: str = "") -> None:
    """Writes the texts in ``value`` in the given order as the one file ``path``; ``none`` is a document without rows."""
    spark = rows.sparkSession
    spark.dataSource.register(_Document)
    # keys travel under names of their own: any column may have the name ``value``
    keys = [(o, False) if isinstance(o, str) else o for o in order]
    kept = rows.select(*(F.col(k).alias(f"__k{i}") for i, (k, _) in enumerate(keys)), F.col(value).alias("__value"))
    by = [F.desc(f"__k{i}") if down else F.asc(f"__k{i}") for i, (_, down) in enumerate(keys)]
    sorted_ = kept.repartitionByRange(*by).sortWithinPartitions(*by) if by else kept
    options = {"path": qualified(spark, path), "before": before, "between": between, "behind": behind, "none": none}
    sorted_.select(F.col("__value").alias("value")).write.format("tidemark_document").mode("append").options(**options).save()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system: a path without a scheme lies where Spark's default file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_json_array(items: DataFrame, order: Order, path: str, value: str = "value") -> None:
    """One JSON array of the JSON texts in ``value``."""
    write_document(items, order, value, path, before="[", between=",", behind="]", none="[]")


def csv_field(c: Column) -> Column:
    """A field as CSV holds it: between quotes where it has a comma, a quote or a line break, quotes inside doubled."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(fields: Column) -> Column:
    """An array of texts as a line of CSV; a lone empty field is quoted, as a blank line would be no record."""
    return F.when((F.size(fields) == 1) & (F.get(fields, 0) == ""), '""').otherwise(F.array_join(F.transform(fields, csv_field), ","))


def write_csv_document(records: DataFrame, order: Order, path: str, null: str = "") -> None:
    """One CSV file of the records ``rec`` (map of JSON texts) under the sorted union of their fields, ``MOST_FIELDS`` at most;
    ``null`` stands for nulls, absent fields are empty. Without records the file is empty."""
    from .convert import text_of_json

    names = [r[0] for r in records.select(F.explode(F.map_keys("rec")).alias("k")).distinct().orderBy("k").limit(MOST_FIELDS + 1).collect()]
    if len(names) > MOST_FIELDS:
        raise Refused("TOO_MANY_FIELDS", f"over {MOST_FIELDS} distinct fields", "records")
    # the names are one constant array, however many: a plan with a column for each would not compile
    shown = lambda v: F.when(v.isNull(), "").when(v == "null", null).otherwise(text_of_json(v))
    fields = F.transform(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), lambda k: shown(F.try_element_at(F.col("rec"), k)))
    head = records.sparkSession.range(1).select(csv_line(F.array(*map(F.lit, names)) if names else F.array(F.lit(""))).alias("h")).first()[0]
    write_document(records.withColumn("__line", F.concat(csv_line(fields), F.lit("\n"))), order, "__line", path, before=head + "\n")
