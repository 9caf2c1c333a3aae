"""WARC files as a chunked record table, and back.

A record is rows (file, record_no, chunk_no): its payload is cut every CHUNK bytes, and each row carries the SHA-256
of the payload up to its end, from one digest that is fed chunk by chunk. Reading and writing go through a stream:
neither holds more of a record than a chunk, and a batch of rows ends once it has BATCH bytes. The header's fields
travel with a record's first row only.

Distribution. Writing: one file for each partition of the input, under a temporary name until it is whole, so a task
that is run again replaces its own file. Reading: one task a file (gzip members can't be split); files are read by
pyarrow's file systems (local, HDFS, S3, ...), wherever the shared folder is.

Defined results. A null html makes no record; an empty one a record with one empty chunk. A null url or page_id leaves
its field out and is null again when read; spaces and control characters in a url are percent-encoded. Rows that repeat each make
a record: such records share their identifier and differ in (file, record_no). A file that ends within a record gives
what is there, and valid is false; a wrong declared digest, too, be it of the block or of the payload (what follows the
HTTP head in an application/http record, else the block), in hexadecimal or base32. If all is right as far as it can be told, but a
digest can't be (of an algorithm that isn't in ALGORITHMS, or of the payload that a revisit record refers to), valid is null. A
header's line that begins with white space continues the one before. Zeros after the last gzip member are passed over. Bytes
that aren't WARC, or not gzip where gzip began, raise ValueError. Empty tables
make no file and give an empty table. Other columns of the input are not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, prepare, written

CHUNK, BATCH, BLOCK, HEADER_MOST = 64 << 10, 8 << 20, 1 << 20, 1 << 20
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
DATE = "2026-01-01T00:00:00Z"
ROWS = pa.schema([
    ("file", pa.string()), ("record_no", pa.int64()), ("chunk_no", pa.int32()), ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()),
    ("length", pa.int64()), ("start", pa.int64()), ("payload", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()), ("valid", pa.bool_()),
])
DDL = "file string, record_no long, chunk_no int, record_id string, type string, url string, page_id long, length long, start long, payload binary, digest string, last boolean, valid boolean"


def located(path: str) -> tuple[fs.FileSystem, str]:
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def pieces(text: str, chars: int = CHUNK // 4) -> Iterator[bytes]:
    for a in range(0, len(text), chars):
        yield text[a : a + chars].encode()


class Writer:
    """Records into one file, each a gzip member of its own (or plain)."""

    def __init__(self, out: Any, gzip: bool = True, date: str = DATE):
        self.out, self.gzip, self.date, self.records = out, gzip, date, 0

    def record(self, text: str, url: str | None, page_id: int | None) -> None:
        digest, length = hashlib.sha256(), 0
        for p in pieces(text):
            digest.update(p)
            length += len(p)
        name = uuid.UUID(hashlib.md5(f"{'' if page_id is None else page_id}\n{url or ''}\n{digest.hexdigest()}".encode()).hexdigest())
        head = [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", self.date)]
        if url is not None:
            head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
        if page_id is not None:
            head.append(("Page-ID", str(page_id)))
        head += [("WARC-Payload-Digest", f"sha256:{digest.hexdigest()}"), ("Content-Type", "text/html"), ("Content-Length", str(length))]
        packer = zlib.compressobj(1, zlib.DEFLATED, 31) if self.gzip else None

        def put(raw: bytes) -> None:
            self.out.write(packer.compress(raw) if packer else raw)

        put(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode())
        for p in pieces(text):
            put(p)
        put(b"\r\n\r\n")
        if packer:
            self.out.write(packer.flush())
        self.records += 1


class Source:
    """Bytes of a file as asked for; gzip members are unpacked one after another."""

    def __init__(self, stream: Any):
        self.stream, self.ready, self.at, self.raw, self.unpacker = stream, b"", 0, b"", None
        first = stream.read(2)
        self.raw, self.gzip = first, first == b"\x1f\x8b"

    def more(self) -> bool:
        """Get at least a byte more, if there is any."""
        rest = self.ready[self.at :]
        while True:
            if not self.raw:
                self.raw = self.stream.read(BLOCK)
                if not self.raw:
                    return False
            if not self.gzip:
                got, self.raw = self.raw, b""
            else:
                if self.unpacker is None:
                    self.raw = self.raw.lstrip(b"\0")  # padding
                    if not self.raw:
                        continue
                    self.unpacker = zlib.decompressobj(31)
                try:
                    got = self.unpacker.decompress(self.raw, BLOCK)
                except zlib.error as e:
                    raise ValueError(f"no gzip: {e}") from e
                self.raw = self.unpacker.unconsumed_tail
                if self.unpacker.eof:
                    self.raw, self.unpacker = self.unpacker.unused_data, None
            if got:
                self.ready, self.at = rest + got, 0
                return True

    def take(self, most: int) -> bytes:
        """Up to most bytes, fewer only at the end."""
        while len(self.ready) - self.at < most and self.more():
            pass
        out = self.ready[self.at : self.at + most]
        self.at += len(out)
        return out

    def header(self) -> bytes | None:
        """Up to the next blank line; None at the end of the file. Only what doesn't begin like a header has a limit."""
        seen = 0
        while True:
            end = self.ready.find(b"\r\n\r\n", self.at + max(0, seen - 3))
            if end >= 0:
                out, self.at = self.ready[self.at : end], end + 4
                return out
            seen = len(self.ready) - self.at
            if seen > HEADER_MOST and not self.ready[self.at : self.at + 64].lstrip(b"\r\n").startswith(b"WARC/"):
                raise ValueError("no WARC header: a blank line is missing")
            if not self.more():
                if self.ready[self.at :].strip():
                    raise ValueError("no WARC header: the file ends within it")
                return None


def fields(lines: list[str]) -> dict[str, str]:
    """The fields of a header by name in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for x in lines:
        if x[:1] in (" ", "\t"):
            if name is not None:
                out[name] = f"{out[name]} {x.strip()}".strip()
        else:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class Declared:
    """A digest that a header declares, held against the bytes as they pass; of a payload, from the end of an HTTP head on."""

    def __init__(self, value: str, headed: bool = False):
        algorithm, _, self.value = value.partition(":")
        algorithm = algorithm.strip().lower().replace("-", "")
        self.digest = hashlib.new(algorithm, usedforsecurity=False) if algorithm in ALGORITHMS else None
        self.headed, self.before = headed, b""

    def update(self, raw: bytes) -> None:
        if self.digest is None:
            return
        if self.headed:
            seen = self.before + raw
            end = seen.find(b"\r\n\r\n")
            if end < 0:
                self.before = seen[-3:]
                return
            self.headed, raw = False, seen[end + 4 :]
        self.digest.update(raw)

    def right(self) -> bool | None:
        if self.digest is None:
            return None
        value = self.value.strip()
        return value.lower() == self.digest.hexdigest() or value.upper().rstrip("=") == base64.b32encode(self.digest.digest()).decode().rstrip("=")


def declared(field: dict[str, str]) -> list[Declared]:
    out = [Declared(field["warc-block-digest"])] if "warc-block-digest" in field else []
    if "warc-payload-digest" in field:
        value = field["warc-payload-digest"] if field.get("warc-type", "").lower() != "revisit" else ""  # that of another record
        out.append(Declared(value, field.get("content-type", "").lower().startswith("application/http")))
    return out


def records(stream: Any, file: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of one file, in order."""
    source, no = Source(stream), 0
    while (head := source.header()) is not None:
        lines = head.lstrip(b"\r\n").decode(errors="replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at record {no} of {file}")
        field = fields(lines[1:])
        if not field.get("content-length", "").isdigit():
            raise ValueError(f"record {no} of {file} has no length")
        length, start, digest, k, checks = int(field["content-length"]), 0, hashlib.sha256(), 0, declared(field)
        while True:
            payload = source.take(min(chunk, length - start))
            digest.update(payload)
            for c in checks:
                c.update(payload)
            end = start + len(payload)
            last = end == length or len(payload) < min(chunk, length - start)
            valid = None
            if last:
                right = [c.right() for c in checks]
                valid = False if end < length or False in right else None if None in right else True
            page = field.get("page-id")
            first = (field.get("warc-record-id"), field.get("warc-type"), field.get("warc-target-uri"), int(page) if page and page.lstrip("-").isdigit() else None, length) if not k else (field.get("warc-record-id"), None, None, None, None)
            yield (file, no, k, *first, start, payload, digest.hexdigest(), last, valid)
            start, k = end, k + 1
            if last:
                break
        source.take(4)
        no += 1


def _write(path: str, gzip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}.warc" + ".gz" * gzip
        hidden, writer = f"{base}/.{name}.{uuid.uuid4().hex}", None
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if writer is None:
                    system.create_dir(base)
                    writer = Writer(system.open_output_stream(hidden, compression=None), gzip)
                writer.record(html, url, page_id)
        if writer:
            writer.out.close()
            if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{base}/{name}")
            system.move(hidden, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([writer.records], pa.int64())], ["file", "records"])

    return run


def write_warc(pages: DataFrame, path: str, *, gzip: bool = True) -> DataFrame:
    """Write (page_id, url, html) as WARC files below path; a table of (file, records)."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").where("html is not null")
    return written(rows.mapInArrow(_write(path, gzip), "file string, records long"), "warc-files")


def _read(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

        for files in batches:
            for file in files.column(0).to_pylist():
                system, name = located(file)
                held, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for row in records(stream, file, chunk):
                        held.append(row)
                        size += len(row[9]) + len(row[5] or "") + 300
                        if size >= BATCH:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return run


def read_warc(files: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the files that a table names in its column file."""
    names = files.select("file").where("file is not null")
    return names.repartition(max(1, min(10_000, files.count())), "file").mapInArrow(_read(chunk), DDL)


def warc_chunks(pages: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Pages written as WARC files in the shared folder and read again: a row for each chunk, payload in base64."""
    path = fresh_path(pages.sparkSession, "warc")
    rows = read_warc(write_warc(pages, path), chunk=chunk)
    return rows.select("page_id", "url", "record_id", "chunk_no", "start", F.regexp_replace(F.base64("payload"), "[\r\n]+", "").alias("payload"), "digest", "last", "valid")


SQL = f"""
WITH p AS (SELECT page_id, url, encode(html) AS b, md5(coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '') || chr(10) || sha256(html)) AS m FROM pages WHERE html IS NOT NULL),
c AS (SELECT *, octet_length(b) AS n, unnest(range(0, greatest(1, (octet_length(b) + {CHUNK - 1}) // {CHUNK}))) AS k FROM p)
SELECT page_id, url, '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' AS record_id,
  k::INTEGER AS chunk_no, k * {CHUNK} AS start, base64(b[k * {CHUNK} + 1:(k + 1) * {CHUNK}]) AS payload, sha256(b[1:(k + 1) * {CHUNK}]) AS digest,
  (k + 1) * {CHUNK} >= n AS last, CASE WHEN (k + 1) * {CHUNK} >= n THEN true END AS valid
FROM c
"""
