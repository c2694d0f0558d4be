"""WARC archives as a chunked record table.

A record is rows ``(archive, record_id, chunk_no, data)``: chunk 0 starts with
the WARC header block, and a payload of any size continues over further chunks
of at most ``chunk_bytes``.  The writer cuts a payload in place, without a copy of the
whole, and the reader holds one chunk and a running digest.  Concatenating ``data`` of an archive in
order of (record_id, chunk_no) gives a WARC/1.1 file byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import stored, tasks_for

CHUNK_BYTES = 256 << 10
CHUNKS = "archive int, record_id long, seq long, chunk_no int, n_chunks int, data binary"
RECORDS = "record_id long, seq long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, n_chunks int, ok boolean"
CRLF = b"\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_header(kind: str, record_id, uri: str, digest: str, length: int, payload_bytes: int, refers_to, date: str) -> bytes:
    """The header block of one record, blank line included.  Line breaks in the URI are escaped."""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def record_chunks(kind: str, record_id, uri: str, payload: memoryview, digest: str, refers_to, date: str, chunk_bytes: int) -> Iterator[bytes]:
    """The bytes of one record in chunks; a revisit carries no payload."""
    body = payload if kind == "response" else payload[:0]
    head = record_header(kind, record_id, uri, digest, len(body), len(payload), refers_to, date)
    at = max(0, chunk_bytes - len(head))
    rest = [] if at >= len(body) else [body[i : i + chunk_bytes] for i in range(at, len(body), chunk_bytes)]
    parts = [head + bytes(body[:at]), *rest]
    for i, part in enumerate(parts):
        yield bytes(part) + (CRLF + CRLF if i == len(parts) - 1 else b"")


def record_length(kind: str, record_id, uri: str, payload: memoryview, digest: str, refers_to, date: str, chunk_bytes: int) -> int:
    """How many chunks record_chunks gives."""
    n = len(payload) if kind == "response" else 0
    head = len(record_header(kind, record_id, uri, digest, n, len(payload), refers_to, date))
    return 1 + max(0, -(-(n - max(0, chunk_bytes - head)) // chunk_bytes))


def write_chunks(rows: DataFrame, archives: int, chunk_bytes: int, date: str) -> DataFrame:
    """rows: (record_id, seq, uri, payload string, record_type, refers_to) -> the chunk table.  ``seq`` tells apart rows that repeat an id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                rid, uri, kind = cols["record_id"][i].as_py(), cols["uri"][i].as_py() or "", cols["record_type"][i].as_py()
                scalar = cols["payload"][i]
                payload = memoryview(scalar.as_buffer()) if scalar.is_valid else memoryview(b"")
                sha = hashlib.sha1()
                for k in range(0, len(payload), chunk_bytes):
                    sha.update(payload[k : k + chunk_bytes])
                digest, refers_to = base32_sha1(sha.digest()), cols["refers_to"][i].as_py()
                total = record_length(kind, rid, uri, payload, digest, refers_to, date, chunk_bytes)
                for n, part in enumerate(record_chunks(kind, rid, uri, payload, digest, refers_to, date, chunk_bytes)):
                    out.append((cols["archive"][i].as_py(), rid, cols["seq"][i].as_py(), n, total, part))
                    size += len(part)
                    if size > (8 << 20):
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    schema = pa.schema([("archive", pa.int32()), ("record_id", pa.int64()), ("seq", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("data", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    placed = rows.withColumn("archive", F.expr(f"cast(pmod(xxhash64(record_id, seq), {archives}) as int)"))
    return placed.mapInArrow(write, CHUNKS)


class RecordParser:
    """Parses one record fed chunk by chunk; keeps the header, a running SHA-1 and a count."""

    def __init__(self):
        self.head, self.fields, self.sha, self.seen, self.tail, self.chunks = b"", None, hashlib.sha1(), 0, b"", 0

    def feed(self, data) -> None:
        self.chunks += 1
        data = memoryview(data)
        if self.fields is None:
            self.head += bytes(data)
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            self.fields = {"version": lines[0]} | {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
            self.length = int(self.fields["content-length"])
            data = memoryview(self.head)[end + 4 :]
        body = data[: max(0, self.length - self.seen)]
        self.sha.update(body)
        self.seen += len(body)
        self.tail += bytes(data[len(body) :])

    def row(self) -> tuple:
        """(record_type, uri, payload_bytes, payload_digest, refers_to, n_chunks, ok)"""
        f = self.fields or {}
        kind, declared = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:")
        refers = f.get("warc-refers-to", "")
        refers = int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers and not refers.endswith(":None>") else None
        digest = base32_sha1(self.sha.digest()) if kind == "response" else declared
        n = self.seen if kind == "response" else int(f.get("warc-payload-length", 0))
        ok = f.get("version") == "WARC/1.1" and self.tail == CRLF + CRLF and digest == declared and self.seen == getattr(self, "length", -1)
        return kind, f.get("warc-target-uri"), n, digest, refers, self.chunks, ok


def read_chunks(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, digests recomputed from the stored bytes; ``ok`` tells whether the record is whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("seq", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("n_chunks", pa.int32()), ("ok", pa.bool_())])
        now, parser, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            ids, seqs, data = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            for i, key in enumerate(zip(ids, seqs, strict=True)):
                if key != now:
                    if parser:
                        out.append((*now, *parser.row()))
                    now, parser = key, RecordParser()
                parser.feed(data[i].as_buffer())
            if len(out) >= 4096:
                yield flush()
                out = []
        if parser:
            out.append((*now, *parser.row()))
        if out:
            yield flush()

    # most records are one chunk and are read where they lie; only the chunks of longer ones are brought together
    cols = chunks.select("record_id", "seq", "chunk_no", "data", "n_chunks")
    single = cols.where("n_chunks = 1").select("record_id", "seq", "chunk_no", "data").mapInArrow(read, RECORDS)
    several = cols.where("n_chunks > 1").repartition(tasks_for(chunks), "record_id", "seq").sortWithinPartitions("record_id", "seq", "chunk_no")
    return single.unionByName(several.select("record_id", "seq", "chunk_no", "data").mapInArrow(read, RECORDS))


def archive_pages(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0, archives: int = 64, chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The stored chunk table with one WARC record per row.

    Of rows with equal payloads (SHA-256 and length; the WARC's own SHA-1 doesn't decide) of at least ``min_bytes`` bytes the largest key is the response and
    the others revisit it; smaller payloads are all responses.  A null payload is empty, a null URI is empty.  Rows that
    repeat a key are records of their own, told apart by ``seq``; all rows of the largest key are responses.  A null key
    sorts below all others.  An empty table gives no records.  Other columns are ignored.
    """
    rows = pages.select(F.col(key).cast("long").alias("record_id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.col("payload").cast("binary"), 256))).withColumn("_len", F.octet_length("payload"))
    groups = rows.groupBy("_sha", "_len").agg(F.max("record_id").alias("keep"), F.count("*").alias("copies")).where(f"copies > 1 AND _len >= {int(min_bytes)}").select("_sha", "_len", "keep")
    typed = rows.join(groups, ["_sha", "_len"], "left").withColumn("_new", F.col("keep").isNull() | F.col("record_id").eqNullSafe(F.col("keep")))
    typed = typed.select(
        "record_id", F.monotonically_increasing_id().alias("seq"), "uri", "payload",
        F.when(F.col("_new"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("_new"), F.col("keep")).alias("refers_to"),
    )
    return stored(write_chunks(typed, archives, chunk_bytes, date), "warc")


def warc_records(pages: DataFrame, **options) -> DataFrame:
    """Write every row as a WARC record, read the archives back: (record_id, record_type, payload_bytes, payload_digest, refers_to, uri, n_chunks, ok)."""
    return read_chunks(archive_pages(pages, **options)).drop("seq")
