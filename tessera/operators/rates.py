"""How fast the stages of a backup run here: reading, cutting, hashing and sealing, in MiB a second of one thread."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import chunking

_BLOCK = 1 << 20
#: Buffers of 1 MiB that sealing is timed over.
SEALED_BUFFERS = 16


def timed(files: DataFrame, open_: Callable[[str], BinaryIO], config: chunking.Config) -> DataFrame:
    """bytes and seconds of each stage (read, cdc, hash) over all files, summed by task. files: path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, spent = 0, [0.0, 0.0, 0.0]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                stream, hashed = chunking.Stream([config], keep=False), hashlib.sha256()
                with open_(path) as f:
                    while True:
                        marks = [time.perf_counter()]
                        block = f.read(_BLOCK)
                        marks.append(time.perf_counter())
                        if not block:
                            break
                        stream.feed(block)
                        marks.append(time.perf_counter())
                        hashed.update(block)
                        marks.append(time.perf_counter())
                        total += len(block)
                        spent = [s + b - a for s, a, b in zip(spent, marks, marks[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(["read", "cdc", "hash"]), pa.array([total] * 3), pa.array(spent)], ["stage", "bytes", "seconds"])

    parts = files.select("path").mapInArrow(run, "stage string, bytes long, seconds double")
    return parts.groupBy("stage").agg(F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))


def sealing(spark: SparkSession) -> tuple[int, float]:
    """Bytes and seconds of sealing buffers of 1 MiB, in one task and without what a job costs besides."""

    def seconds(buffers: int) -> float:
        plain = F.repeat(F.lit("x"), _BLOCK).cast("binary")
        sealed = F.octet_length(formats.seal(plain, F.lit(bytes(32)), F.lit(bytes(12)), F.col("id").cast("string").cast("binary")))
        began = time.perf_counter()
        spark.range(0, buffers, 1, 1).agg(F.sum(sealed)).collect()
        return time.perf_counter() - began

    seconds(1)  # compiles
    return SEALED_BUFFERS * _BLOCK, max(1e-9, seconds(SEALED_BUFFERS) - seconds(0))


def measured(files: DataFrame, open_: Callable[[str], BinaryIO], config: chunking.Config) -> DataFrame:
    """stage, bytes, seconds and rate of read, cdc, hash and seal; the rate is infinite where there was nothing to time."""
    spark = files.sparkSession
    rows = timed(files, open_, config).unionByName(spark.createDataFrame([("seal", *sealing(spark))], "stage string, bytes long, seconds double"))
    return rows.withColumn("rate", formats.mib_per_second(F.col("bytes"), F.col("seconds")))
