"""WARC archives with a two-level capture index.

Archives are written by tasks into the shared folder, one gzip member per record, so any record can be read by its
offset and length. Of captures with equal payloads the one with the largest page_id is a `response`; the others are
`revisit` records that name it and hold its HTTP head only.

The index sorts captures by reversed-host URL key and id, and packs runs of lines into compressed blocks, kept as a
Parquet table beside the archives. Its sparse directory holds the first key of each block; blocks take more lines as
captures grow, so that the directory never has more than about `DIRECTORY` entries and can be sent to every task. A
lookup finds the block by binary search in the directory, opens each block once, finds the lines by binary search in
it, and reads the records' byte ranges.

A retried task writes a file of its own; only files that the committed index names are ever read.

Defined results: a null html is an empty payload; a null url gets the key `-`; a null page_id is smaller than all
others; rows of one payload and the largest page_id are all responses if they repeat; every row has a record of its
own; an empty table gives no records and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._cluster import bounded_batches, checkpoint, fresh_dir, salted_join

BLOCK_LINES = 2000
DIRECTORY = 100_000
ARCHIVE_BYTES = 1 << 30
#: Compressed bytes and records that one task reads back.
READ_BYTES, READ_RECORDS = 8 << 20, 20_000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CDX = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: hosts of one domain sort together."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url, safe="")
    port = "" if port in (None, 80, 443) else f":{port}"
    path = parts.path or "/"
    key = ",".join(reversed(host.split("."))) + port + ")" + path + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20]", lambda m: quote(m[0]), key)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, response: bool) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~", encoding="utf-8") if url is not None else f"urn:x-page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if not response:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{response_id}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    ident = lambda x: None if x is None or x.endswith(":None>") else int(x.rpartition(":")[2][:-1])
    return {"page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": ident(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


@dataclass
class Archive:
    """Where the archives and their index are."""

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("block long, first_key string, first_id long, lines long, data binary").parquet(f"{self.path}/index")

    def directory(self) -> list[tuple[str, int, int]]:
        """First key, first id and number of each block, in order; about DIRECTORY entries at most."""
        rows = self.blocks().select("first_key", "first_id", "block").collect()
        return sorted((r[0], _least(r[1]), r[2]) for r in rows)


def _least(page_id: int | None) -> int:
    return -(2**63) if page_id is None else page_id


def write(pages: DataFrame, path: str | None = None) -> Archive:
    """Writes all pages (page_id, url, html) as archives with an index."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = path or fresh_dir(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("response_id"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        out = None
        try:
            for batch in batches:
                lines = []
                for page_id, url, html, sha, response_id in zip(*(batch.column(k) for k in ("page_id", "url", "html", "sha", "response_id")), strict=True):
                    page_id, url, response_id = page_id.as_py(), url.as_py(), response_id.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    raw = record(page_id, url, html.as_py().encode(), digest, response_id, page_id == response_id)
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packed = gzip.compress(raw, 6, mtime=0)
                    out.write(packed)
                    lines.append((url_key(url), page_id, name, at, len(packed)))
                    at += len(packed)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = zip(*lines, strict=True) if lines else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    # a payload that many pages share is dealt over many tasks
    captures = checkpoint(salted_join(rows, first, "sha", "page_id").select("page_id", "url", "html", "sha", "response_id").mapInArrow(put, _CDX))
    _index(captures, path)
    return Archive(spark, path)


def _index(captures: DataFrame, path: str) -> None:
    size = max(BLOCK_LINES, -(-captures.count() // DIRECTORY))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            nonlocal number
            text = "\n".join("\t".join(["" if x is None else str(x) for x in line]) for line in held).encode()
            made = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((number, pa.int64()), (held[0][0], pa.string()), (held[0][1], pa.int64()), (len(held), pa.int64()), (zlib.compress(text), pa.binary()))], ["block", "first_key", "first_id", "lines", "data"])
            number += 1
            held.clear()
            return made

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                if len(held) >= size:
                    yield close()
        if held:
            yield close()

    ordered = captures.repartitionByRange(F.col("key"), F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("key"), F.col("page_id").asc_nulls_first(), "archive", "offset")
    ordered.mapInArrow(pack, "block long, first_key string, first_id long, lines long, data binary").write.parquet(f"{path}/index")


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The captures of each wanted (url, page_id): url_key, page_id, archive, offset, length. A pair's captures all come."""
    directory = archive.directory()
    firsts = [(k, i) for k, i, _ in directory]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page_id in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                ask = (url_key(url), _least(page_id))
                # equal pairs may begin in the block before the first that starts with them
                low, high = max(0, bisect_left(firsts, ask) - 1), bisect_right(firsts, ask)
                out += [(directory[b][2], ask[0], page_id) for b in range(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["block", "key", "page_id"])

    asked = wanted.select("url", "page_id").mapInArrow(find, "block long, key string, page_id long").distinct()

    def match(asks: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for data in blocks.column("data").to_pylist():
            lines = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
            keys = [(x[0], _least(int(x[1]) if x[1] else None)) for x in lines]
            for key, page_id in zip(asks.column("key").to_pylist(), asks.column("page_id").to_pylist(), strict=True):
                ask = (key, _least(page_id))
                found += [(key, page_id, *lines[i][2:]) for i in range(bisect_left(keys, ask), bisect_right(keys, ask))]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array([int(x[k]) if k > 2 else x[k] for x in found], t) for k, t in enumerate(kinds)], names=["key", "page_id", "archive", "offset", "length"])

    return asked.groupBy("block").cogroup(archive.blocks().select("block", "data").groupBy("block")).applyInArrow(match, _CDX)


def read(archive: Archive, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures by range reads: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload."""
    path = archive.path
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = []
                for archive_, offset, length in zip(*(batch.slice(start, 256).column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                    if archive_ != name:
                        if source is not None:
                            source.close()
                        name, source = archive_, store.open_input_file(f"{base}/{archive_}")
                    found.append(parse(gzip.decompress(source.read_at(length, offset))))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], list(kinds))
        if source is not None:
            source.close()

    captures = checkpoint(captures.select("archive", "offset", "length"))
    n, size = captures.agg(F.count("*"), F.sum("length")).first()
    tasks = max(1, -(-n // READ_RECORDS), -(-(size or 0) // READ_BYTES))
    ordered = captures.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads
    return ordered.mapInArrow(get, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: all pages written, looked up by the index and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write(pages)
    found = lookup(archive, pages.select("url", "page_id"))
    return read(archive, found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS top FROM p GROUP BY x)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.x, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN p.page_id IS NOT DISTINCT FROM m.top THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN p.page_id IS NOT DISTINCT FROM m.top THEN NULL ELSE m.top END AS refers_to
FROM p JOIN m ON p.x = m.x
"""
