"""WARC archives as a PySpark data source.

``spark.read.format("warc")`` plans one partition for each archive file. Filters on record_type, record_id and
target_uri are pushed down; a record's headers are parsed first, and a record that the filters refuse, or whose payload
is not asked for, is passed over without decoding it: in files written here each gzip member bears its compressed length
(a gzip extra field), so the reader seeks to the next. Options: ``payload`` is ``full``, ``digest`` (default: length and
SHA-1 of the bytes read, no payload column filled) or ``none`` (headers only).

``df.write.format("warc")`` writes records of ``warc_columns``. Each task writes files of its own names; the commit
lists those of the successful attempts in a manifest, and only listed files are read, so tasks may be lost and run
again. Paths are opened by Arrow's file systems (local or shared folders, object stores, HDFS); ``write_archives`` and
``read_archives`` first give a path without a scheme that of Spark's default file system.

Defined cases: null payload is an empty one; of records with equal payloads that with the smallest page_id is the
response and the others revisit it; rows that repeat both page_id and payload, or have no page_id, are all responses;
very long payloads are records like any other; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..sources.files import SCHEMES
from ._common import materialise, scratch_path, small_or_plain, spread_join

#: Rows of a batch that are plain objects at a time.
SLICE_ROWS = 256
#: Compressed bytes after which a task begins a new file.
FILE_BYTES = 64_000_000
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, file string, offset bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there of an address as Spark writes it."""
    if "://" in uri:
        scheme, rest = uri.split("://", 1)
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    if uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, record_type: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers only, with the length and digest of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(uri or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if record_type == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its compressed and plain length in an extra field 'sl'."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields = path, fields

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        at = [self.fields.index(c) for c in ("record_id", "record_type", "target_uri", "payload", "refers_to")]
        parts = (b.slice(lo, SLICE_ROWS) for b in iterator for lo in range(0, b.num_rows, SLICE_ROWS))
        for record_id, kind, uri, payload, refers in (row for p in parts for row in zip(*(p.column(i).to_pylist() for i in at))):
            if out is None or size > FILE_BYTES:
                if out is not None:
                    out.close()
                files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            member = gzip_member(record_bytes(record_id, kind, uri, payload or b"", refers))
            out.write(member)
            size += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{root}/{f}")


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "record_id", "target_uri")

    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in self.PUSHED and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in self.PUSHED and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in self.PUSHED and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        system, root = opened(self.path)
        info = system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else None
        if info is None:
            return [ArchiveFile(root)]
        listed = [f.path for f in info if f.base_name.startswith("_manifest-")]
        if listed:
            names = {n for m in listed for n in json.loads(system.open_input_stream(m).read())}
            return [ArchiveFile(f"{root}/{n}") for n in sorted(names)]
        return [ArchiveFile(f.path) for f in sorted(info, key=lambda f: f.path) if f.base_name.endswith((".warc", ".warc.gz"))]

    def refused(self, row: dict) -> bool:
        return any(row[c] not in v if how == "in" else not (row[c] or "").startswith(v) for c, how, v in self.tests)

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        system, _ = opened(self.path)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        rows, held = [], 0
        with system.open_input_file(partition.path) as f:
            for offset, head, body in records(f):
                row = header_columns(head)
                if self.refused(row):
                    continue
                row |= {"payload": None, "file": partition.path.rsplit("/", 1)[-1], "offset": offset}
                if self.payload != "none" and row["record_type"] != "revisit":
                    payload = http_payload(head, body())
                    row |= {"payload_bytes": len(payload), "payload_digest": sha1_base32(payload)}
                    row["payload"] = payload if self.payload == "full" else None
                    held += len(payload) if self.payload == "full" else 0
                elif row["record_type"] == "revisit":
                    row["payload_bytes"] = http_length(body())
                rows.append(row)
                if len(rows) >= 4096 or held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_head(data: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def header_columns(head: dict[str, str]) -> dict:
    digest = head.get("warc-payload-digest", "")
    bare = lambda k: head[k].strip("<>") if k in head else None
    return {
        "record_id": bare("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
        "refers_to": bare("warc-refers-to"), "payload_bytes": None, "payload_digest": digest.rpartition(":")[2].upper() or None,
    }


def http_payload(head: dict[str, str], block: bytes) -> bytes:
    """The block without HTTP headers, if it is an HTTP message."""
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def http_length(block: bytes) -> int | None:
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    return None


def records(f) -> Iterator[tuple[int, dict[str, str], object]]:
    """(offset, headers, function that gives the block) of each record of an open archive; blocks not asked for are skipped."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        start = f.read(24)
        if start[:2] == b"\x1f\x8b":
            known = struct.unpack("<I", start[16:20])[0] if start[3] == 4 and start[12:14] == b"sl" else 0
            f.seek(at)
            stream, plain = _Inflated(f, known), b""
            plain = stream.until(b"\r\n\r\n")
            yield at, *_record(plain, stream.more)
            at += known or stream.finish()
        else:
            f.seek(at)
            raw = _Plain(f)
            plain = raw.until(b"\r\n\r\n")
            if not plain.strip():
                return
            yield at, *_record(plain, raw.more)
            at += plain.index(b"\r\n\r\n") + 4 + int(parse_head(plain.partition(b"\r\n\r\n")[0]).get("content-length", 0)) + 4


def _record(plain: bytes, more) -> tuple[dict[str, str], object]:
    head_bytes, _, begun = plain.partition(b"\r\n\r\n")
    head = parse_head(head_bytes.lstrip(b"\r\n"))
    length = int(head.get("content-length", 0))
    return head, lambda: (begun + more(length - len(begun)))[:length]


class _Plain:
    def __init__(self, f):
        self.f = f

    def until(self, end: bytes) -> bytes:
        out = b""
        while end not in out and (part := self.f.read(4096)):
            out += part
        return out

    def more(self, n: int) -> bytes:
        return self.f.read(n) if n > 0 else b""


class _Inflated:
    """A gzip member read as far as needed."""

    def __init__(self, f, known: int):
        self.f, self.z, self.taken = f, zlib.decompressobj(31), 0
        self.step = min(known, 1 << 16) or 1 << 16

    def _next(self, n: int) -> bytes:
        data = self.z.unconsumed_tail
        if not data:
            data = self.f.read(self.step)
            self.taken += len(data)
        return self.z.decompress(data, n) if data else b""

    def until(self, end: bytes) -> bytes:
        out = b""
        while end not in out and not self.z.eof and (part := self._next(2048)):
            out += part
        return out

    def more(self, n: int) -> bytes:
        parts = []
        while n > 0 and not self.z.eof and (part := self._next(n)):
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def finish(self) -> int:
        while not self.z.eof and self._next(1 << 16):
            pass
        return self.taken - len(self.z.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "digest"))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def as_records(pages: DataFrame) -> DataFrame:
    """Records of pages (page_id, url, html): responses, and revisits of equal payloads seen under a smaller page_id."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    narrow = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha"))
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id")
    first, _ = materialise(first, "warc-first")
    again = spread_join(narrow, first, "sha", first.count()).filter("page_id > first_id").select("page_id", "sha", "first_id").distinct()
    again = small_or_plain(again, again.count())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    return rows.join(again, ["page_id", "sha"], "left").select(
        urn("page_id").alias("record_id"),
        F.when(F.col("first_id").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(F.col("first_id").isNotNull(), urn("first_id")).alias("refers_to"),
        "payload",
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark finds it in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records (as of as_records) as archives below the path."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(qualified(records.sparkSession, path))


def read_archives(spark: SparkSession, path: str, payload: str = "digest") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(qualified(spark, path))


def archive_digest(pages: DataFrame) -> DataFrame:
    """Writes the pages as WARC archives in the shared folder and digests the records read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(as_records(pages), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return read_archives(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")
