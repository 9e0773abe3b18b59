"""Duplicate and cross-version overlap of chunks. A tree's chunks: path, seq, chunk_id, len."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import ordered


def unique(chunks: DataFrame) -> DataFrame:
    """Every id once, with its length."""
    return chunks.groupBy("chunk_id").agg(F.max("len").alias("len"))


def first_occurrence(chunks: DataFrame) -> DataFrame:
    """Every id with the path and place of its first occurrence, found before the shuffle by each task."""
    return chunks.groupBy("chunk_id").agg(F.min(F.struct("path", "seq", "len")).alias("f")).select("chunk_id", "f.path", "f.seq", "f.len")


def overlap(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: unique ids of the current tree, those shared with the baseline, and the share in per cent."""
    now = unique(current).select("chunk_id", F.lit(1).alias("now"))
    was = unique(baseline).select("chunk_id", F.lit(1).alias("was"))
    n, shared = F.count("*"), F.count("was")
    return now.join(was, "chunk_id", "left").agg(n.alias("unique_chunks"), shared.alias("shared_chunks"), F.when(n > 0, shared / n * 100).otherwise(0.0).alias("overlap_pct"))


def delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Unique chunks of the current tree that the baseline lacks."""
    return unique(current).join(baseline.select("chunk_id"), "chunk_id", "left_anti")


def shipped(chunks: DataFrame, chunk_index: DataFrame) -> DataFrame:
    """Unique chunks with whether they must be shipped, in one join."""
    held = chunk_index.select("chunk_id", F.lit(True).alias("held"))
    return unique(chunks).join(held, "chunk_id", "left").select("chunk_id", "len", F.col("held").isNull().alias("ship"))


def ledger(files: DataFrame, chunks: DataFrame, chunk_index: DataFrame, overhead: int = 41) -> DataFrame:
    """One row of a backup's counts; a shipped chunk costs its frame and seal besides. files: path, size."""
    total = chunks.agg(F.count("*").alias("chunks_total"))
    tree = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_bytes"))
    sent = shipped(chunks, chunk_index).agg(
        F.count("*").alias("chunks_unique"),
        F.count_if("ship").alias("chunks_uploaded"),
        F.count_if(~F.col("ship")).alias("chunks_deduped"),
        F.coalesce(F.sum(F.when(F.col("ship"), F.col("len") + overhead)), F.lit(0)).cast("long").alias("upload_bytes"),
    )
    return tree.join(total, F.lit(True)).join(sent, F.lit(True))  # tables of one row


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Adds the offset of each chunk in its file."""
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))


def progress(files: DataFrame, by: str) -> DataFrame:
    """Running files and bytes along a column's order, inside each root. files: root, path, size."""
    return ordered.along(files, "root", [by], {"files_done": F.lit(1).cast("long"), "bytes_done": F.col("size").cast("long")})


def batches(chunks: DataFrame, most_chunks: int = 64, most_bytes: int = 32 << 20) -> DataFrame:
    """Adds the number of the upload batch: a batch is closed when it has so many chunks or bytes.

    The cut depends on all before it, so a root's chunks are folded in order. chunks: root, seq, len, each chunk once
    (see first_occurrence).
    """

    def cut(state: tuple[int, int, int], row: tuple | None) -> tuple[tuple[int, int, int], list[tuple]]:
        if row is None:
            return state, []
        number, n, size = state
        n, size = n + 1, size + row[2]
        return (number + 1, 0, 0) if n >= most_chunks or size >= most_bytes else (number, n, size), [(*row, number)]

    plain = chunks.select(F.col("root").cast("string"), F.col("seq").cast("long"), F.col("len").cast("long"))
    return ordered.folded(plain, "root", ["seq"], lambda: (0, 0, 0), cut, "root string, seq long, len long, batch long", [pa.string(), pa.int64(), pa.int64(), pa.int64()])


def throttled(ticks: DataFrame, every_ms: int = 150) -> DataFrame:
    """Ticks that are shown: so long after the last shown, and always the final one. ticks: run, at_ms."""

    def show(state: tuple[int | None, int | None], row: tuple | None) -> tuple[tuple, list[tuple]]:
        shown, last = state[0], state[1]
        if row is None:
            return state, [(last[0], last[1])] if last != shown else []
        if shown is None or row[1] - shown[1] >= every_ms:
            return (row, row), [row]
        return (shown, row), []

    kind = ticks.schema["run"].dataType
    plain = ticks.select("run", F.col("at_ms").cast("long"))
    return ordered.folded(plain, "run", ["at_ms"], lambda: (None, None), show, f"run {kind.simpleString()}, at_ms long", [to_arrow_type(kind), pa.int64()])


def united(trees: list[DataFrame], roots: list[str]) -> DataFrame:
    """Several trees as one, each path under its root's name; equal names are refused. trees: path, ..."""
    if len(set(roots)) != len(roots):
        raise ValueError("two roots have one name")
    out = None
    for tree, root in zip(trees, roots, strict=True):
        here = tree.withColumn("path", F.concat(F.lit(f"{root}/"), F.col("path")))
        out = here if out is None else out.unionByName(here)
    return out


def places(files: DataFrame) -> DataFrame:
    """Adds by_path, each file's place in its root by whole path, and by_directory, names in order directory by directory.

    The two differ where a name holds a byte below the slash. files: root, path.
    """
    whole = ordered.along(files, "root", ["path"], {"by_path": F.lit(1).cast("long")})
    return ordered.along(whole, "root", [F.split("path", "/"), F.col("path")], {"by_directory": F.lit(1).cast("long")})
