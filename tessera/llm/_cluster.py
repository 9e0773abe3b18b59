"""What the operators share about the cluster: the shared folder, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a few plain columns that are broadcast; larger sides are shuffled.
BROADCAST_ROWS = 400_000


#: What one Arrow batch holds at most between the JVM and Python; one longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which by default hold 10,000 rows or 64 MB; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one, which goes with the process; any other raises an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by fresh_dir() once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the counted rows are few enough; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= most else df


#: Parts that each key of salted_join() is dealt over before Spark splits any further.
SALTS = 8


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of many rows with a table of one row a key, where one key may hold a third of the rows.

    Each row goes to one of SALTS parts of its key by a hash of another column, and the table's rows to all. As both
    sides then come straight from a shuffle, the adaptive skew join can split a part that is still too large.
    """
    salt = "_salt"
    copies = keyed.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, salt]).drop(salt)


def table_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a table that needs no Python worker to read. schema: names and types, as for a struct."""
    kind = ", ".join(":".join(x.split()) for x in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller slices, so that what is made of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
