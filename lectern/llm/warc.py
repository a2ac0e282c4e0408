"""WARC: write pages as archives, and read archives back.

Archives hold one gzip member for each record. The reader is sequential: it inflates a stream piece by piece, frames
records by Content-Length, computes the digests of blocks and payloads as they pass, and compares them with the
headers, so that it never holds an archive and, unless payloads are asked for, no payload either.

Scale: a task writes archives of bounded size into the shared folder, under names that hold the attempt, and returns a
manifest. The manifest is a table of its own, so only archives of attempts that Spark committed are ever read; what a
lost executor leaves behind is not named anywhere. One archive is one task's work when reading.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_hot, read, with_key, written

#: An archive is closed beyond so many bytes; the reader asks for so many at a time; headers end within so many.
ARCHIVE, PIECE, HEADER = 64 << 20, 1 << 16, 1 << 20
_NAMES = uuid.UUID("6a0d7c1e-52a7-5d7e-9c38-1f0f3d0f4c55")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Hadoop's names of stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def filesystem(path: str):
    """The store of a path, for executors: (pyarrow file system, path in it). Stores that Arrow does not know are an error."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.FileSystem.from_uri(path if path.startswith("/") else f"file://{path.removeprefix('file:')}")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member. Line ends in values become spaces; fields without a value are left out."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in fields if v is not None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, name: str, refers_to: str | None, date: str) -> bytes:
    """The record called name; with refers_to, the name of another, a revisit of that one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(name)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("WARC-Profile", _REVISIT if revisit else None),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return record(fields, http if revisit else http + payload)


class Inflated:
    """Read a file of gzip members: read(n) gives up to n bytes of the current member, b"" at its end."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.ahead, self.member, self.rest = raw, b"", None, b""

    def next_member(self) -> bool:
        if not self.ahead:
            self.ahead = self.raw.read(PIECE)
        if not self.ahead:
            return False
        self.member, self.rest = zlib.decompressobj(31), b""
        return True

    def read(self, n: int) -> bytes:
        while not self.rest and not self.member.eof:
            given = self.member.unconsumed_tail + self.ahead or self.raw.read(PIECE)
            if not given:
                raise ValueError("archive ends inside a gzip member")
            self.ahead = b""
            self.rest = self.member.decompress(given, PIECE)
            if self.member.eof:
                self.ahead = self.member.unused_data
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _until(source: Inflated, mark: bytes, held: bytes) -> tuple[bytes, bytes]:
    while (k := held.find(mark)) < 0:
        if len(held) > HEADER:
            raise ValueError("header without end")
        if not (piece := source.read(PIECE)):
            raise ValueError("record ends inside its header")
        held += piece
    return held[:k], held[k + len(mark) :]


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(raw: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """Read an archive record by record: its headers, payload_bytes, payload_digest, and the payload if asked for.

    Raises ValueError where an archive ends early, a member holds anything but one record of the announced length, or
    a digest does not fit. The digest of a revisit is the header's, as its payload is elsewhere.
    """
    source = Inflated(raw)
    while source.next_member():
        head, held = _until(source, b"\r\n\r\n", b"")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _headers(head)
        left = int(fields["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        size, kept, http = 0, [], b""
        in_payload = not fields.get("content-type", "").startswith("application/http")
        while left:
            piece = held or source.read(PIECE)
            if not piece:
                raise ValueError("record is shorter than its Content-Length")
            piece, held = piece[:left], piece[left:]
            left -= len(piece)
            block.update(piece)
            if not in_payload:
                http += piece
                if (k := http.find(b"\r\n\r\n")) < 0:
                    if len(http) > HEADER:
                        raise ValueError("HTTP header without end")
                    continue
                in_payload, piece = True, http[k + 4 :]
            payload.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        while piece := source.read(PIECE):
            held += piece
            if len(held) > 4:
                break
        if held != b"\r\n\r\n":
            raise ValueError("a member holds more or less than one record")
        found = {"block": base64.b32encode(block.digest()).decode(), "payload": base64.b32encode(payload.digest()).decode()}
        revisit = fields.get("warc-type") == "revisit"
        for what, digest in found.items():
            told = fields.get(f"warc-{what}-digest")
            if told and told != f"sha1:{digest}" and not (revisit and what == "payload"):
                raise ValueError(f"{what} digest of {fields.get('warc-record-id')} does not fit")
        told = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
        yield {"fields": fields, "payload_bytes": size, "payload_digest": told if revisit else found["payload"], "payload": b"".join(kept) if payloads else None}


def _write(folder: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        size = n = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, urls, names, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            html = pc.fill_null(batch.column(2).cast(pa.binary()), b"")
            for k in range(batch.num_rows):
                if out is None:
                    # each attempt has names of its own
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                payload = html[k].as_py()
                data = page_record(ids[k], urls[k], payload, base32_sha1(payload), names[k], refers[k], date)
                out.write(data)
                size += len(data)
                n += 1
                if size >= ARCHIVE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each row as a record, and return the manifest (path, records, bytes), itself a written table.

    Of rows with equal payloads (null: empty) the one with the smallest id, ids before none, is a response; the others are
    revisits that refer to it. Whole repeated rows are records of their own: one is the response, the rest revisit it.
    A record's id is made from the page's and the row's place, so that no two are equal. Further columns are ignored. An
    empty table gives no archive.
    """
    rows = with_key(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "key")
    rows = rows.withColumn("sha", F.sha1(F.coalesce(F.col("html"), F.lit(""))))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rows.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select("sha", "n", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "payloads")
    total = first.agg(F.sum("n")).first()[0] or 0
    name = lambda i, k: F.concat(F.coalesce(F.col(i).cast("string"), F.lit("-")), F.lit("/"), F.hex(k))
    planned = join_hot(rows, first, "sha", "n", total, "left").select(
        "id", "url", "html", name("id", "key").alias("name"), F.when(F.col("first_key") != F.col("key"), name("first_id", "first_key")).alias("refers_to")
    )
    return written(planned.mapInArrow(_write(folder, date), "path string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the archives a manifest names: a row for each record, with every digest verified.

    Columns: page_id, url, record_id, record_type, refers_to_id, payload_bytes (of what the record holds),
    payload_digest, payload (null unless asked for). Pages without an id or a url have nulls; an empty manifest gives no
    rows; a path that it names twice is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = filesystem(path)
                rows: list[dict] = []
                held = 0
                with store.open_input_stream(inner, compression=None) as raw:
                    for r in records(raw, payloads):
                        f = r["fields"]
                        page = f.get("x-page-id")
                        rows.append({"page_id": None if page is None else int(page), "url": f.get("warc-target-uri"), "record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"), "refers_to_id": f.get("warc-refers-to"), "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "payload": r["payload"]})
                        held += len(r["payload"] or b"")
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    # ranges of the paths' order, as many as paths: one archive a task
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(
        run, "page_id long, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
    )


def resolved(found: DataFrame) -> DataFrame:
    """Records with payload_bytes and refers_to (a page id) of revisits taken from the response that they refer to.

    A revisit whose response is missing, or has another digest, is an error. refers_to is null if the response's page has
    no id. Ids may be null or repeat. Large numbers of revisits of one response are met by broadcast.
    """
    found = written(found.drop("payload"), "records")
    responses = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("response_bytes"), F.col("payload_digest").alias("response_digest")
    )
    revisits = found.where("record_type = 'revisit'")
    counts = written(revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n")).join(responses, "refers_to_id", "left"), "responses")
    met = join_hot(revisits.select("page_id", "url", "payload_digest", "record_type", "refers_to_id"), counts, "refers_to_id", "n", counts.agg(F.sum("n")).first()[0] or 0)
    good = F.when(F.col("response_digest") == F.col("payload_digest"), F.col("response_bytes")).otherwise(F.raise_error("a revisit's digest is not its response's"))
    return found.where("record_type = 'response'").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(met.select("page_id", "url", good.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return resolved(read_archives(spark, manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), d AS (
  SELECT page_id, payload_bytes, k, first, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)) AS parts FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) % 32 + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM d
"""
