"""WARC archives: one gzip member per record, read back in sequence."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, prepared
from weftgraph.session import broadcast_if_small

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
#: Bytes of one archive, about.
ARCHIVE_BYTES = 16 << 20
LEVEL = 6
#: Payloads that occur more than once and whose table is broadcast; of more, it is shuffled.
BROADCAST_ROWS = 100_000
_ID = "urn:weftgraph:page:"
# Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member of its own; line ends within a header's value are percent-encoded."""
    lines = [_VERSION, *(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A page as response, or as a revisit of the page that refers_to names, with the response's head but without payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")] if revisit else []
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
    return member(headers, block)


def members(archive: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, one after another, decompressed a chunk at a time."""
    at = 0
    view = memoryview(archive)
    while at < len(archive):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + chunk]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> Record:
    """A record by its framing; its content length and block digest must hold."""
    head, separator, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not separator or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    length = int(headers.get("content-length", "-1"))
    block, end = rest[:length], rest[length:]
    if length < 0 or len(block) != length or end != b"\r\n\r\n":
        raise ValueError("content length does not frame the record")
    if (said := headers.get("warc-block-digest", "")) and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest does not match")
    return Record(headers, block)


def write_archives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): WARC files of about archive_bytes with a record for each page, payload its html in UTF-8.

    Of payloads that are equal and long enough, the page of smallest id is a
    response and the others revisit it; null html is empty, a null url has no
    header, a null id is not the smallest unless all are null. Pages that repeat
    the smallest id with the same payload are responses too.
    """
    spark = prepared(pages.sparkSession)
    scratch = Scratch(spark, "warc")
    keyed = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("digest", F.sha2("payload", 256))
    again = keyed.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = keyed.join(broadcast_if_small(scratch.stored(again), BROADCAST_ROWS), "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{number:04d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(page_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    return joined.select("id", "url", "payload", "digest", "first", revisit.alias("revisit")).mapInArrow(run, "archive string, content binary")


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of (archive, content): page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload.

    A record whose frame or digest doesn't hold raises; a revisit has no payload
    of its own (null), its length and digest are those of the full payload.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        for raw in members(content):
            headers, block = parse(raw)
            kind = headers["warc-type"]
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            length = int(re.search(rb"(?i)\ncontent-length: *(\d+)", head)[1])
            if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError("payload digest does not match")
            refers = _number(headers["warc-refers-to"]) if kind == "revisit" else None
            yield _number(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, kind, refers, payload if kind == "response" else None

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                held: list[tuple] = []
                for row in rows(content.as_py()):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    prepared(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives into the shared folder, and what reading those gives. An empty table gives an empty table."""
    scratch = Scratch(prepared(pages.sparkSession), "archives")
    return read_archives(scratch.stored(write_archives(pages)))
