"""One large CSV file, or one large JSON array, read by many tasks.

Spark's text source splits a file into byte ranges of pieces between separators: line feeds for CSV, commas for JSON. Whether a
separator ends a record depends on what lies before it: a quoted field or a string may hold it, and a comma may lie in a
nested value. So there are three steps:

1. Each range is scanned from both states, outside and inside quotes. What the scan does to the state is a map of two values,
   and with it come the change of depth and the number of records that start, by depth.
2. An exclusive scan over the ranges of a file composes these maps: a map is constant or keeps or swaps the state, so the
   state before a range is that of the last constant one, swapped as often as the maps since then say. Depths, first row
   numbers and, for a record that is cut by a range's end, the range that it starts in follow in the same way.
3. Ranges are read again, each from its own state, and give whole records and, at either end, parts of records; parts meet by
   the range that the record starts in. Records are numbered from 0 in the order of the file.

Only the table of ranges is broadcast: a row for each range of ``spark.sql.files.maxPartitionBytes``, at most ``MOST_RANGES``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.coerce import infer_csv
from ..scratch import held

MOST_RANGES = 1_000_000
BOM = b"\xef\xbb\xbf"

#: what a piece does to a scan that begins outside (False) or inside (True) of quotes: (inside, change of depth) behind it
Step = Callable[[bytes, bool], tuple[bool, int]]

_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
_STRING = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)


def csv_step(sep: bytes) -> Step:
    def step(line: bytes, inside: bool) -> tuple[bool, int]:
        if b'"' not in line:
            return inside, 0
        at = 0
        while inside or at < len(line):
            if inside or line[at] == 34:
                end = _QUOTED.match(line, at if inside else at + 1)
                if end is None:
                    return True, 0
                at, inside = end.end(), False
            at = line.find(sep, at) + 1  # text behind a closing quote, and quotes inside bare fields, are plain text
            if not at:
                break
        return False, 0

    return step


def json_step(piece: bytes, inside: bool) -> tuple[bool, int]:
    at = depth = 0
    while True:
        if inside:
            end = _STRING.match(piece, at)
            if end is None:
                return True, depth
            at, inside = end.end(), False
        quote = piece.find(b'"', at)
        bare = piece[at:] if quote < 0 else piece[at:quote]
        depth += bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}")
        if quote < 0:
            return False, depth
        at, inside = quote + 1, True


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))


def _opened(piece: bytes, array: bool) -> bytes:
    """A file's first piece without its byte order mark and, for an array, its opening bracket."""
    piece = piece.removeprefix(BOM)
    if array:
        bare = piece.lstrip(b" \t\r\n")
        if not bare.startswith(b"["):
            raise Refused("INVALID_INPUT", "a JSON array starts with [", "path")
        return bare[1:]
    return piece


def _blank(piece: bytes, array: bool) -> bool:
    return not array and piece in (b"", b"\r")


def _ranges(pieces: DataFrame, step: Step, array: bool) -> DataFrame:
    """(file, at, inside, depth, row, owner, last): each range's state, depth and first row number; ``owner``: where the record
    that it begins in the middle of started. ``last``: the state, depth and number of rows behind it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        state: dict[bool, tuple[bool, int]] = {}
        starts: dict[bool, Counter] = {}

        def row() -> pa.RecordBatch:
            out = [[now[0]], [now[1]]]
            for s in (False, True):
                out += [[state[s][0]], [state[s][1]], [list(starts[s].items())]]
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(out, _SUMMARY_TYPES, strict=True)], names=_SUMMARY)

        for batch in batches:
            for file, at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, at) != now:
                    if now is not None:
                        yield row()
                    now, state, starts = (file, at), {False: (False, 0), True: (True, 0)}, {False: Counter(), True: Counter()}
                    piece = _opened(piece, array) if at == 0 else piece
                blank = _blank(piece, array)
                if state[False] == state[True]:  # both scans have met
                    todo = {False: state[False]}
                else:
                    todo = dict(state)
                after: dict[tuple[bool, int], tuple[bool, int]] = {}
                for s, (inside, depth) in todo.items():
                    moved = step(piece, inside)
                    after[s] = (moved[0], depth + moved[1])
                for s in (False, True):
                    inside, depth = state[s]
                    if not inside and not blank:
                        starts[s][depth] += 1
                    state[s] = after[s] if s in after else after[False]
        if now is not None:
            yield row()

    kinds = "file string, at bigint, in_out boolean, depth_out bigint, starts_out map<bigint, bigint>, in_in boolean, depth_in bigint, starts_in map<bigint, bigint>"
    found = held(pieces.mapInArrow(scan, kinds), "ranges")
    if found.count() > MOST_RANGES:
        raise Refused("TOO_MANY_RANGES", f"over {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes", "path")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("in_out") == F.col("in_in")
    swaps = F.col("in_out") & ~F.col("in_in")
    stepped = found.withColumn("swaps", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    own = F.when(constant, F.struct(F.col("in_out").alias("state"), (F.col("swaps") + swaps.cast("int")).alias("swaps")))
    stepped = stepped.withColumn("base", F.last(own, ignorenulls=True).over(before))
    flips = F.col("swaps") - F.coalesce(F.col("base.swaps"), F.lit(0))
    inside = F.coalesce(F.col("base.state"), F.lit(False)) != (flips % 2 == 1)
    stepped = stepped.withColumn("inside", inside).withColumn("moved", F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out")))
    stepped = stepped.withColumn("depth", F.coalesce(F.sum("moved").over(before), F.lit(0)))
    starts = F.when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out"))
    stepped = stepped.withColumn("rows", F.coalesce(F.try_element_at(starts, -F.col("depth")), F.lit(0)))
    stepped = stepped.withColumn("row", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    behind = F.struct(F.when(F.col("inside"), F.col("in_in")).otherwise(F.col("in_out")).alias("inside"), (F.col("depth") + F.col("moved")).alias("depth"), (F.col("row") + F.col("rows")).alias("rows"))
    owner = F.last(F.when(F.col("rows") > 0, F.col("at")), ignorenulls=True).over(before)
    return held(stepped.select("file", "at", "inside", "depth", "row", owner.alias("owner"), behind.alias("last")), "states")


_SUMMARY = ["file", "at", "in_out", "depth_out", "starts_out", "in_in", "depth_in", "starts_in"]
_SUMMARY_TYPES = [pa.string(), pa.int64(), *([pa.bool_(), pa.int64(), pa.map_(pa.int64(), pa.int64())] * 2)]


def _records(pieces: DataFrame, ranges: DataFrame, step: Step, array: bool) -> DataFrame:
    """(file, row, raw): the bytes of every record, blank CSV lines left out."""
    glue = b"," if array else b"\n"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        inside, depth, row, owner = False, 0, 0, None
        record: list[bytes] | None = None  # of the record at hand; None: a blank line, or nothing yet
        own = False  # whether the record started in this range
        out: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal record, row
            if record is not None:
                out.append((now[0], row if own else None, now[1] if own else owner, now[1], whole and own, glue.join(record)))
                row += own
            record = None

        def flush() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _PART_TYPES, strict=True)], names=_PARTS)
            out.clear()
            return got

        for batch in batches:
            size = 0
            for file, at, piece, in0, depth0, row0, owner0 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, at) != now:
                    close(False)
                    now, inside, depth, row, owner = (file, at), in0, depth0, row0, owner0
                    record, own = ([], False) if inside or depth else (None, False)
                    piece = _opened(piece, array) if at == 0 else piece
                elif not inside and depth == 0:
                    close(True)
                if record is None and not _blank(piece, array):
                    record, own = [], True
                if record is not None:
                    record.append(piece)
                    size += len(piece)
                inside, moved = step(piece, inside)
                depth += moved
                if size > 4 << 20 and out:
                    yield flush()
                    size = 0
            if out:
                yield flush()
        close(False)
        if out:
            yield flush()

    parts = pieces.join(F.broadcast(ranges.select("file", "at", "inside", "depth", "row", "owner")), ["file", "at"]).select("file", "at", "piece", "inside", "depth", "row", "owner")
    kinds = "file string, row bigint, owner bigint, at bigint, whole boolean, raw binary"
    found = parts.mapInArrow(cut, kinds)
    # what a range's end cuts, at most two parts of each range; the last record of each range is among them
    open_ = found.where("NOT whole").groupBy("file", "owner").agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("at", F.col("raw").cast("string").alias("raw")))).alias("p"))
    joined = open_.select("file", "row", F.array_join(F.transform("p", lambda x: x["raw"]), glue.decode()).cast("binary").alias("raw"))
    return found.where("whole").select("file", "row", "raw").unionByName(joined)


_PARTS = ["file", "row", "owner", "at", "whole", "raw"]
_PART_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def split_fields(raw: bytes, sep: bytes = b",") -> list[str]:
    """The fields of one CSV record; doubled quotes inside quotes are one."""
    raw = raw.removesuffix(b"\r") if not raw.endswith(b'"') else raw
    out, at = [], 0
    while True:
        text = b""
        if raw[at : at + 1] == b'"':
            end = _QUOTED.match(raw, at + 1)
            stop = end.end() if end else len(raw) + 1  # a quote that is never closed ends with the file
            text, at = raw[at + 1 : stop - 1].replace(b'""', b'"'), stop
        end = raw.find(sep, at)
        out.append((text + raw[at : end if end >= 0 else None]).decode("utf-8"))
        if end < 0:
            return out
        at = end + len(sep)


def csv_rows(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, row, fields array<string>): the records of CSV files in order; row 0 is a file's header. Fields may hold line
    breaks, and a record may be longer than a range. Blank lines are no records. Bytes that are no UTF-8 refuse, and so do
    carriage returns alone as ends of lines."""
    if len(sep) != 1 or sep in '"\r\n':
        raise Refused("INVALID_INPUT", "a separator is one character, and no quote or line break", "sep")
    raw_sep = sep.encode()
    pieces, step = _pieces(spark, path, "\n"), csv_step(raw_sep)
    records = _records(pieces, _ranges(pieces, step, False), step, False)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                fields = [split_fields(x, raw_sep) for x in batch.column(2).to_pylist()]
            except UnicodeDecodeError as e:
                raise Refused("NOT_TEXT", f"the bytes are no UTF-8: {e}", "path") from None
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fields, pa.list_(pa.string()))], names=["file", "row", "fields"])

    return records.mapInArrow(split, "file string, row bigint, fields array<string>")


def csv_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, row, rec map<string, string>): the rows of CSV files, from 1, under each file's own header, as JSON texts inferred
    losslessly field by field; of columns of one name the last counts. A row with more or fewer fields than its header
    refuses, and names its place."""
    rows = held(csv_rows(spark, path, sep), "rows")
    last = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.array_contains(F.slice(h, i + 2, F.size(h)), F.get(h, i)))
    heads = rows.where("row = 0").select("file", F.col("fields").alias("head"), last(F.col("fields")).alias("at"))
    if heads.count() <= 10_000:  # a row for each file
        heads = F.broadcast(heads)
    return rows.where("row > 0").join(heads, "file").select("file", "row", _typed(F.col("head"), F.col("at"), F.col("fields")).alias("rec"))


def _typed(head: Column, at: Column, fields: Column) -> Column:
    odd = F.concat(F.lit("INVALID_INPUT: row "), F.col("row"), F.lit(" of "), F.col("file"), F.lit(" has "), F.size(fields), F.lit(" fields, its header "), F.size(head))
    rec = F.map_from_entries(F.transform(at, lambda i: F.struct(F.get(head, i), infer_csv(F.get(fields, i)))))
    return F.when(F.size(fields) != F.size(head), F.raise_error(odd).cast("map<string,string>")).otherwise(rec)


def json_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, value): the elements of files that hold one JSON array each, as JSON texts, from 0. What is no array, or no
    JSON, refuses."""
    from ..functions.text import is_json

    pieces = _pieces(spark, path, ",")
    ranges = _ranges(pieces, json_step, True)
    # the closing bracket takes the depth to -1
    if ranges.limit(1).count() == 0:
        raise Refused("INVALID_INPUT", "an empty file is no JSON array", "path")
    bad = ranges.groupBy("file").agg(F.max_by("last", "at").alias("last")).where("last.inside OR last.depth <> -1").limit(1).collect()
    if bad:
        raise Refused("INVALID_INPUT", f"no JSON array: {bad[0]['file']}", "path")
    ends = ranges.groupBy("file").agg(F.max_by("last.rows", "at").alias("n"))
    found = _records(pieces, ranges, json_step, True).join(F.broadcast(ends), "file")  # fewer rows than ranges
    text = F.col("raw").cast("string")
    is_last = F.col("row") == F.col("n") - 1
    value = F.regexp_replace(F.when(is_last, F.regexp_replace(text, r"\][ \t\r\n]*$", "")).otherwise(text), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    full = found.select("file", "row", value.alias("value"), is_last.alias("is_last")).where(~((F.col("row") == 0) & F.col("is_last") & (F.col("value") == "")))
    sound = F.is_valid_utf8("value") & is_json(F.col("value"))
    return full.select("file", "row", F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("INVALID_INPUT: element "), F.col("row"), F.lit(" of "), F.col("file"), F.lit(" is no JSON")))).alias("value"))
