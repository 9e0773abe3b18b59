"""Chunk-size sizing: exact aggregates, nearest-rank percentiles, projections and the recommendation.

files: path, size; chunks: target_size, path, chunk_id, len, one set for each candidate size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.schemas import CHUNK_ID, INDEX_RECORD, MANIFEST_FILE, MANIFEST_HEADER


def manifest_bytes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """target_size and the bytes of one snapshot's manifest; files without chunks count too."""
    base = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("path_bytes"))
    counts = chunks.groupBy("target_size").agg(F.count("*").alias("n"))
    return counts.join(base, F.lit(True)).select("target_size", (MANIFEST_HEADER + MANIFEST_FILE * F.col("files") + F.col("path_bytes") + CHUNK_ID * F.col("n")).cast("long").alias("manifest_bytes"))


def report(files: DataFrame, chunks: DataFrame, snapshots: int, baseline: DataFrame | None = None, sizes: list[int] | None = None) -> DataFrame:
    """One row for each candidate size; for each of `sizes`, if given, even without chunks.

    Chunks are read once and meet once, by (size, id), where repeats end; a baseline's ids (chunks as above) take part
    there, so the overlap costs no join. What is left for each size is a histogram of lengths, from whose running
    counts the exact nearest-rank percentiles over all occurrences follow.
    """
    now = chunks.select("target_size", "chunk_id", "len", F.lit(1).alias("now"), F.lit(0).alias("was"))
    if baseline is not None:
        now = now.unionByName(baseline.select("target_size", "chunk_id", "len", F.lit(0).alias("now"), F.lit(1).alias("was")))
    by_id = now.groupBy("target_size", "chunk_id").agg(F.max(F.when(F.col("now") == 1, F.col("len"))).alias("len"), F.sum("now").alias("n"), F.max("was").alias("was")).filter("n > 0")
    by_len = by_id.groupBy("target_size", "len").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("was").alias("shared"))
    upto = W.partitionBy("target_size").orderBy("len").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = by_len.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("target_size")))
    rank = lambda p: F.min(F.when(F.col("upto") >= F.expr(f"(all * {p} + 99) div 100"), F.col("len")))
    out = ranked.groupBy("target_size").agg(
        F.sum("n").alias("total_chunks"), F.sum("ids").alias("unique_chunks"), F.sum(F.col("len") * F.col("n")).alias("total_bytes"), F.sum(F.col("len") * F.col("ids")).alias("unique_bytes"), F.sum("shared").alias("shared_chunks"), rank(50).alias("p50"), rank(95).alias("p95")
    )
    if sizes is not None:
        out = out.sparkSession.createDataFrame([(x,) for x in sizes], "target_size long").join(out, "target_size", "left")
    counts = ("total_chunks", "unique_chunks", "total_bytes", "unique_bytes", "shared_chunks", "p50", "p95")
    base = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("path_bytes"))
    # one row for each candidate from here on
    out = out.select("target_size", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]).join(base, F.lit(True))
    out = out.withColumn("manifest_bytes", MANIFEST_HEADER + MANIFEST_FILE * F.col("files") + F.col("path_bytes") + CHUNK_ID * F.col("total_chunks"))
    index = F.col("unique_chunks") * INDEX_RECORD
    book = index + snapshots * F.col("manifest_bytes")
    return out.select(
        "target_size",
        "total_chunks",
        "unique_chunks",
        "total_bytes",
        "unique_bytes",
        F.when(F.col("unique_bytes") > 0, F.round(F.col("total_bytes") / F.col("unique_bytes"), 6)).otherwise(1.0).alias("dedup_ratio"),
        F.when(F.col("total_chunks") > 0, F.round(F.col("total_bytes") / F.col("total_chunks"), 6)).otherwise(0.0).alias("mean_len"),
        "p50",
        "p95",
        index.cast("long").alias("index_bytes"),
        F.col("manifest_bytes").cast("long").alias("manifest_bytes"),
        book.cast("long").alias("bookkeeping_bytes"),
        (book + F.col("unique_bytes")).cast("long").alias("cost"),
        F.when(F.col("unique_chunks") > 0, F.round(F.col("shared_chunks") / F.col("unique_chunks") * 100, 6)).otherwise(0.0).alias("overlap_pct"),
    )


def recommend(rows: DataFrame) -> DataFrame:
    """The candidate of least cost, of equal ones the smaller size; no rows without candidates. rows: target_size, cost."""
    return rows.agg(F.min_by("target_size", F.struct("cost", "target_size")).alias("target_size"), F.min("cost").alias("cost")).filter(F.col("target_size").isNotNull())


def candidates(sizes: list[int]) -> list[int]:
    """Sizes in the order given, each once; a size must be in range."""
    out = list(dict.fromkeys(sizes))
    for size in out:
        if not 256 <= size <= 4 << 20:
            raise ValueError(f"target size {size} is out of range")
    return out
