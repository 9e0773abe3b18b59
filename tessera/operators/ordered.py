"""Running sums, places and folds along an order, where one key may hold very many rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places that one task sums up in running().
RUN = 1024
#: Rows that one task orders in along().
PART_ROWS = 50_000


def running(sums: DataFrame, keys: list[str], at: str, n: str, out: str) -> DataFrame:
    """Adds to rows of (keys, at, n) the sum of n over all lesser `at`, which count from 0, of the same keys.

    Runs of places are summed up apart and then the runs, so a key of many places doesn't meet in one task.
    """
    inner = sums.withColumn("_run", F.floor(F.col(at) / RUN))
    runs = inner.groupBy(*keys, "_run").agg(F.sum(n).alias("_of"))
    above = runs.select(*keys, "_run", (F.sum("_of").over(W.partitionBy(*keys).orderBy("_run")) - F.col("_of")).alias("_above"))
    inside = F.sum(n).over(W.partitionBy(*keys, "_run").orderBy(at)) - F.col(n)
    return inner.withColumn(out, inside).join(above, [*keys, "_run"]).withColumn(out, F.col(out) + F.col("_above")).drop("_run", "_above")


def along(rows: DataFrame, key: str, order: list[str | Column], sums: dict[str, Column], n_rows: int | None = None) -> DataFrame:
    """Adds running sums up to and with each row, along an order inside each key.

    Rows are dealt over tasks by ranges of key and order; each task adds up its own, and what stands before a task's
    rows of a key comes from the sums of the tasks before it, a row for each task and key. The deal depends on a sample,
    so it is written down once. Rows that the order doesn't tell apart may take each other's places.
    """
    from tessera.streaming.folders import scratch

    spark = rows.sparkSession
    mark = uuid.uuid4().hex[:8]
    part, parts = f"_part_{mark}", {name: f"_sum{i}_{mark}" for i, name in enumerate(sums)}
    tasks = max(1, -(-(n_rows if n_rows is not None else rows.count()) // PART_ROWS))
    path = scratch(spark, "along")
    rows.repartitionByRange(tasks, key, *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    upto = W.partitionBy(part, key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = dealt.groupBy(key, part).agg(*[F.sum(c).alias(parts[name]) for name, c in sums.items()])
    earlier = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = held.select(key, part, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in parts.values()])
    own = dealt.select("*", *[F.sum(c).over(upto).alias(name) for name, c in sums.items()])
    return own.join(before, [key, part]).select(*rows.columns, *[(F.col(name) + F.col(p)).alias(name) for name, p in parts.items()])


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Folds each key's rows in order; rows stream through, so a key of any size takes the memory of one batch.

    step(state, row) gives the next state and the rows that leave; row is a tuple of the columns, and None at the key's
    end. One key's rows pass through one task, as each step depends on the one before it.
    """
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, any_ = None, None, [], False
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], [f"c{i}" for i in range(len(kinds))])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_ or row[at] != now:
                    if any_:
                        out += step(state, None)[1]
                    now, state, any_ = row[at], start(), True
                state, gone = step(state, row)
                out += gone
            yield made()
            out.clear()
        if any_:
            out += step(state, None)[1]
            yield made()

    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    plain = ", ".join(f"c{i} {x.strip().split(' ', 1)[1]}" for i, x in enumerate(schema.split(",")))
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, plain).toDF(*names)
