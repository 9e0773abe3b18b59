"""Putting files together again, with checks, and the manifest's own bytes."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.schemas import MANIFEST


def exploded(manifests: DataFrame) -> DataFrame:
    """References in order, repeats kept: snapshot_id, path, file_no, chunk_no, chunk_id. manifests: the manifest schema."""
    files = manifests.select("snapshot_id", F.posexplode("files").alias("file_no", "file"))
    return files.select("snapshot_id", "file.path", "file_no", F.posexplode("file.chunks").alias("chunk_no", "chunk_id"))


def unpacked(packed: DataFrame) -> DataFrame:
    """The ids in a value of 32-byte ids side by side: snapshot_id, seq, chunk_id. packed: snapshot_id, refs."""
    n = (F.octet_length("refs") / 32).cast("int")
    seq = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return packed.select("snapshot_id", "refs", seq.alias("seq")).select("snapshot_id", "seq", F.substring(F.col("refs"), F.col("seq") * 32 + 1, F.lit(32)).alias("chunk_id"))


def assembled(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file's content in the references' order. refs: path, seq, chunk_id; chunks: chunk_id, data (text or bytes).

    A file whose chunks are not all there has a null content and counts them as missing.
    """
    joined = refs.join(chunks, "chunk_id", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"])
    empty = F.lit("").cast(chunks.schema["data"].dataType)
    whole = F.aggregate(F.col("parts"), empty, lambda a, x: F.concat(a, x))
    return joined.groupBy("path").agg(parts.alias("parts"), F.count_if(F.col("data").isNull()).alias("missing")).select("path", F.when(F.col("missing") == 0, whole).alias("content"), "missing")


def checked(files: DataFrame, got: DataFrame) -> DataFrame:
    """The outcome for each file: ok or the first thing that is wrong. files: path, size; got: path, seq, asked_id, sent_id, real_id, len.

    Chunks must come for every place asked, be those asked for, hash to their ids, and add up to the file's size.
    """
    per = got.groupBy("path").agg(
        F.count_if(F.col("sent_id").isNull()).alias("absent"),
        F.count_if(F.col("sent_id") != F.col("asked_id")).alias("other"),
        F.count_if(F.col("real_id") != F.col("sent_id")).alias("altered"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"),
        (F.max("seq") + 1 - F.count("*")).alias("gaps"),
    )
    outcome = (
        F.when(~formats.safe_path(F.col("path")), "unsafe_path")
        .when(F.coalesce(F.col("gaps"), F.lit(0)) != 0, "out_of_order")
        .when(F.col("absent") > 0, "missing_chunk")
        .when(F.col("other") > 0, "wrong_chunk")
        .when(F.col("altered") > 0, "hash_mismatch")
        .when(F.coalesce(F.col("bytes"), F.lit(0)) != F.col("size"), "size_mismatch")
        .otherwise("ok")
    )
    return files.join(per, "path", "left").select("path", outcome.alias("outcome"))


def restore_ledger(outcomes: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files and bytes restored, and files that failed."""
    ok = F.col("outcome") == "ok"
    return outcomes.join(files, "path").agg(F.count_if(ok).alias("files"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(~ok).alias("failed"))


def encode_manifest(row: dict) -> bytes:
    """A manifest as bytes: a header of 28, then each file's 32, its path and its chunks' ids; little-endian."""
    out = [struct.pack("<16sqI", bytes(row["snapshot_id"]), row["created_at"], len(row["files"]))]
    for f in row["files"]:
        path, chunks = f["path"].encode(), f["chunks"]
        out.append(struct.pack("<IQqIII", len(path), f["size"], f["mtime_secs"], f["mtime_nanos"], f["mode"], len(chunks)))
        out += [path, *(bytes(c) for c in chunks)]
    return b"".join(out)


def decode_manifest(raw: bytes) -> dict:
    """The manifest of some bytes; anything cut short, left over or not UTF-8 is an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("truncated manifest")
        at += n
        return raw[at - n : at]

    snapshot_id, created_at, n = struct.unpack("<16sqI", take(28))
    files = []
    for _ in range(n):
        path_len, size, secs, nanos, mode, chunks = struct.unpack("<IQqIII", take(32))
        path = take(path_len).decode()
        files.append({"path": path, "size": size, "mtime_secs": secs, "mtime_nanos": nanos, "mode": mode, "chunks": [take(32) for _ in range(chunks)]})
    if at != len(raw):
        raise ValueError("bytes after the manifest")
    return {"snapshot_id": snapshot_id, "created_at": created_at, "files": files}


def encoded(manifests: DataFrame) -> DataFrame:
    """A blob for each manifest. manifests: the manifest schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([rows.column("snapshot_id"), pa.array([encode_manifest(r) for r in rows.to_pylist()], pa.binary())], ["snapshot_id", "blob"])

    return manifests.select("snapshot_id", "created_at", "files").mapInArrow(run, "snapshot_id binary, blob binary")


def decoded(blobs: DataFrame) -> DataFrame:
    """Manifests of a column of blobs. blobs: blob."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([decode_manifest(bytes(b)) for b in batch["blob"]], columns=["snapshot_id", "created_at", "files"])

    return blobs.select("blob").mapInPandas(run, MANIFEST)


def write_files(files: DataFrame, parts: DataFrame, target: str) -> int:
    """Writes files below a new or empty folder that this machine reaches; returns how many.

    files: path, mtime_secs, perhaps mtime_nanos, mode; parts: path, seq, data. Parts stream to the driver in order, one
    partition at a time, as a restore's target is one machine's folder; no file is ever held whole.
    """
    if os.path.isdir(target) and os.listdir(target):
        raise FileExistsError(f"{target} is not empty")
    os.makedirs(target, exist_ok=True)
    safe = files.filter(formats.safe_path(F.col("path")))
    for row in safe.select("path").toLocalIterator():
        place = os.path.join(target, row["path"])
        os.makedirs(os.path.dirname(place), exist_ok=True)
        open(place, "wb").close()
    for row in parts.join(safe.select("path"), "path", "left_semi").orderBy("path", "seq").select("path", "data").toLocalIterator():
        with open(os.path.join(target, row["path"]), "ab") as f:
            f.write(bytes(row["data"]))
    n = 0
    for row in safe.toLocalIterator():
        place = os.path.join(target, row["path"])
        at = row["mtime_secs"] * 10**9 + (row["mtime_nanos"] if "mtime_nanos" in row else 0)
        os.chmod(place, row["mode"] & 0o777)
        os.utime(place, ns=(at, at))
        n += 1
    return n
