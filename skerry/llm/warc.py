"""WARC: pages written as gzip members, one a record, and read back sequentially.

Writing: of records with equal payloads the one with the largest ``page_id`` is a
``response``; the others are ``revisit`` records that name it.  Reading: members
are decompressed incrementally with zlib, framed by Content-Length, and every
digest is verified.

Defined cases: a null html is an empty payload; a null url is written empty; a
null ``page_id`` revisits the others of its group, or is a response when the
group has no other id; rows that repeat the winning ``page_id`` are responses
all.  Archives live in the shared folder; each task writes to a file of its own
and renames it when complete, so a lost executor leaves no half archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read_table, scratch_dir

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 0
#: An archive is closed when it has reached so many compressed bytes.
ARCHIVE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 16


class WarcError(ValueError):
    """A record that is not framed or digested as its header says."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _parse_id(text: str | None) -> int | None:
    value = text[len("<urn:x-page:"):-1] if text else "null"
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as pieces of decompressed bytes.  A
    member's pieces must be used up before the next is asked for."""
    pending = stream.read(READ_BYTES)
    while pending:
        z = zlib.decompressobj(31)

        def pieces(z=z) -> Iterator[bytes]:
            nonlocal pending
            while not z.eof:
                if not pending:  # the stream is at its end, but zlib may hold output back
                    if rest := z.flush():
                        yield rest
                    if not z.eof:
                        raise WarcError("the archive ends within a member")
                    return
                out = z.decompress(pending, READ_BYTES * 4)
                pending = z.unused_data if z.eof else z.unconsumed_tail
                if not z.eof and not pending:
                    pending = stream.read(READ_BYTES)
                if out:
                    yield out

        yield pieces()
        if not z.eof:
            raise WarcError("a member was not read to its end")
        pending = pending or stream.read(READ_BYTES)


def _take_head(buffer: bytearray, pieces: Iterator[bytes]) -> bytes:
    while (at := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a header has no end")
        buffer += piece
    head = bytes(buffer[:at])
    del buffer[: at + 4]
    return head


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_record(pieces: Iterator[bytes]) -> dict:
    """Parse and verify one record."""
    buffer = bytearray()
    head = _take_head(buffer, pieces)
    if not head.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    fields = _fields(head)
    left = int(fields["content-length"])
    block, block_hash = bytearray(), hashlib.sha1()
    while True:
        part = buffer[:left]
        block += part
        block_hash.update(part)
        left -= len(part)
        del buffer[: len(part)]
        if not left:
            break
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a block is shorter than its Content-Length")
        buffer += piece
    for piece in pieces:
        buffer += piece
    if buffer != b"\r\n\r\n":
        raise WarcError("a record does not end where its Content-Length says")
    if "sha1:" + base64.b32encode(block_hash.digest()).decode() != fields["warc-block-digest"]:
        raise WarcError("block digest differs")
    payload = bytes(block[block.index(b"\r\n\r\n") + 4:])
    declared = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (digest32(payload) != declared or len(payload) != int(fields["x-payload-length"])):
        raise WarcError("payload digest differs")
    return {
        "page_id": _parse_id(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "payload_bytes": int(fields["x-payload-length"]), "payload_digest": declared,
        "refers_to": _parse_id(fields.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload,
    }


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI with its scheme, as ``scratch_dir`` gives them."""
    local = re.fullmatch(r"file:/+(.*)", uri)
    return (pafs.LocalFileSystem(), f"/{local[1]}") if local else pafs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: which record each page becomes.
    The html is shuffled once, by its digest; a hot payload is split by AQE."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    winners = pages.select("page_id", F.sha1(F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("winner"))
    same = F.col("page_id").eqNullSafe(F.col("winner"))
    revisit = ~same & (F.octet_length("payload") >= min_bytes)
    return rows.join(winners, "digest").select("page_id", "url", "payload", F.when(revisit, F.col("winner")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records to ``folder``; one row (path, n_records) an archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        # a task that runs again writes archives of its own; the manifest names those that count
        part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out, number
            out.close()
            final = f"{base}/part-{part:06d}-{number:04d}-{attempt}.warc.gz"
            fs.move(name, final)
            done.append((final, count))
            out, number = None, number + 1

        for b in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                if out is None:
                    name, size, count = f"{base}/.writing-{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = member(record(page_id, url, payload, refers_to, revisit))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    return materialize(arrow_map(records, write, "path string, n_records long"), "warc-manifest")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that ``manifest`` lists, verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                rows, size, total = [], 0, 0
                with fs.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as stream:
                    for pieces in members(stream):
                        rows.append(row := read_record(pieces))
                        size, total = size + len(row["payload"] or b""), total + 1
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                if total != expected:
                    raise WarcError(f"{path} has {total} records of {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    spread = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return arrow_map(manifest.repartition(spread, "path"), read, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(read_table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


