"""WARC archives as a Spark data source in Python.

Reading plans one partition per archive file (small files share one). Within a file each record's headers are parsed
first; predicates on the record type and on headers, pushed down by Spark, decide whether its payload is needed at all.
Records are gzip members of their own; writers note each member's length in its gzip header (the extra field ``sl``), so a
reader that does not want a payload seeks to the next record without inflating the rest. Files without the field, and
uncompressed ones, are read too.

Writing goes through hidden files that are renamed when the job commits, so failed or repeated tasks leave nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import BATCH_BYTES, Scratch, open_path, qualified, scratch_path

FORMAT = "warc_archive"
SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, "
    "payload binary, file string, offset bigint"
)
_BATCH = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GROUP = 64 << 20
_ROLL = 256 << 20


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member that names its own length."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def http_block(payload: bytes | None, size: int) -> bytes:
    """The response's header, and its payload where it is carried."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")


@dataclass
class Raw:
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Member:
    """Inflates one record step by step from an open file; ``plain`` reads it as it is."""

    def __init__(self, f, offset: int):
        self.f, self.offset, self.size = f, offset, None
        f.seek(offset)
        first = f.read(24)
        self.packed = first[:2] == b"\x1f\x8b"
        if self.packed:
            self.z = zlib.decompressobj(31)
            if first[3] & 4 and first[12:14] == b"sl" and struct.unpack("<H", first[14:16])[0] == 8:
                self.size = struct.unpack("<I", first[16:20])[0]
        f.seek(offset)
        self.buffer, self.rest = b"", b""

    def more(self, n: int = 1 << 16) -> bool:
        """False at the member's end."""
        if not self.packed:
            got = self.f.read(n)
            self.buffer += got
            return bool(got)
        if self.z.eof:
            return False
        src = self.z.unconsumed_tail or self.f.read(1 << 13)
        if not src:
            raise ValueError(f"the record at {self.offset} is cut off")
        self.buffer += self.z.decompress(src, n)
        return True

    def until(self, mark: bytes) -> bytes:
        """What stands before ``mark``, however long: a url may be."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more(max(1 << 16, seen)):
                raise ValueError(f"no end of headers in the record at {self.offset}")
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more(1 << 20):
                raise ValueError(f"the record at {self.offset} is shorter than its length")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def end(self, left: int) -> int:
        """The next record's offset; ``left``: bytes of the block not taken yet."""
        if not self.packed:
            return self.f.tell() - len(self.buffer) + left + 4
        if self.size:
            return self.offset + self.size
        while self.more(1 << 20):
            self.buffer = b""
        return self.f.tell() - len(self.z.unused_data)


def records(f, size: int, wanted, with_payload: bool) -> Iterator[Raw]:
    """The records of an open archive for which ``wanted(headers)`` holds. Of others, only headers are inflated."""
    at = 0
    while at < size:
        m = _Member(f, at)
        head = m.until(b"\r\n\r\n").lstrip(b"\r\n").split(b"\r\n")
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = _fields(head[1:])
        left, http, payload = int(headers.get("content-length", 0)), {}, None
        if wanted(headers):
            if headers.get("content-type", "").startswith("application/http") and left:
                before = m.until(b"\r\n\r\n")
                left -= len(before) + 4
                http = _fields(before.split(b"\r\n")[1:])
            if with_payload:
                payload = m.take(left)
                left = 0
            yield Raw(at, headers, http, payload)
        at = m.end(left)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]

    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


_PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if name in _PUSHED:
                values = None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.tests.append((_PUSHED[name], values))
            else:
                yield f

    def partitions(self):
        system, at = open_path(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        groups, total = [], 0
        for p in files:
            if not groups or total + p[1] > _GROUP:
                groups.append([])
                total = 0
            groups[-1].append(p)
            total += p[1]
        return [Files(g) for g in groups]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) is not None and (v is None or headers[k] in v) for k, v in self.tests)

    def read(self, partition):
        if not partition:
            return
        system, _ = open_path(self.path)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.paths:
            with system.open_input_file(path) as f:
                for r in records(f, size, self._wanted, self.with_payload):
                    h = r.headers
                    length = r.http.get("content-length")
                    if length is None or not length.isdigit():
                        length = len(r.payload) if r.payload is not None else None
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), int(length) if length is not None else None, r.payload, path, r.offset))
                    held += len(r.payload or b"")
                    if len(rows) >= _BATCH or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, payload_digest, refers_to, payload_bytes, payload."""

    def __init__(self, path: str, names: list[str], date: str | None = None):
        self.path, self.names, self.job = path, names, uuid.uuid4().hex
        self.date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        system, root = open_path(self.path)
        hidden = f"{root}/_{self.job}"
        system.create_dir(hidden, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.rename_columns(self.names).to_pylist():
                if out is None or size >= _ROLL:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{hidden}/{files[-1]}", compression=None), 0
                headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"] or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date)]
                for k, c in (("WARC-Target-URI", "target_uri"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Refers-To", "refers_to")):
                    if row[c] is not None:
                        headers.append((k, row[c]))
                if row["record_type"] == "revisit":
                    headers.append(("WARC-Profile", PROFILE))
                headers.append(("Content-Type", "application/http; msgtype=response"))
                payload = row["payload"] if row["record_type"] != "revisit" else None
                record = member(headers, http_block(payload, row["payload_bytes"]))
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, root = open_path(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{root}/_{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        system, root = open_path(self.path)
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


class WarcSource(DataSource):
    """Options: path; payload (default true; false leaves payloads undecoded and null); date of written records (default:
    when the job began)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], schema.names, self.options.get("date"))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand predicates to Python sources (off by default)."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _base32(hex_digest):
    """Upper-case base32 of a hexadecimal digest of whole 5-byte groups: 10 hex digits give 8 characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i):
        n = F.conv(F.substr(hex_digest, i * 10 + 1, F.lit(10)), 16, 10).cast("bigint")
        five = lambda s: F.substr(alphabet, F.shiftright(n, s).bitwiseAND(31).cast("int") + 1, F.lit(1))
        return F.concat(*(five(s) for s in range(35, -1, -5)))

    return F.concat(*(group(F.lit(i)) for i in range(4)))


def page_records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Records to write for ``pages`` (page_id, url, html): of equal payloads of ``revisit_bytes`` or more, the smallest
    page_id's is a response and the others' are revisits of it; smaller payloads are all responses.

    A null html is an empty payload. Rows that repeat the smallest page_id are all responses; a row without page_id
    revisits one that has an id, and is a response if there is none.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("target_uri"), body.alias("payload"))
    keys = rows.where(F.octet_length("payload") >= revisit_bytes).select("page_id", F.sha1("payload").alias("sha1"))
    firsts = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    again = keys.join(firsts, "sha1").where("page_id IS NULL OR page_id <> first").select("page_id", "sha1", "first").distinct()
    held = rows.withColumn("sha1", F.sha1("payload")).alias("r").join(again.alias("a"), F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.sha1") == F.col("a.sha1")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    return held.select(
        urn(F.col("r.page_id")).alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("target_uri"),
        F.concat(F.lit("sha1:"), _base32(F.col("r.sha1"))).alias("payload_digest"),
        urn(F.col("first")).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records_df: DataFrame, path: str) -> None:
    register(records_df.sparkSession)
    records_df.write.format(FORMAT).mode("append").save(qualified(records_df.sparkSession, path))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(qualified(spark, path))


def archive_pages(pages: DataFrame, path: str | None = None, revisit_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).
    Lengths and digests of responses are taken from the payloads read; revisits carry theirs in their headers, and their
    payloads are not there to decode. No pages give no rows."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(page_records(pages, revisit_bytes), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    full = read(spark, path).where(F.col("record_type") == "response")
    full = full.select(number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), _base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    light = read(spark, path, payload=False).where(F.col("record_type") == "revisit")
    light = light.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))
    return full.union(light)
