"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._cluster import checkpoint, salted_join


def _least(pairs: DataFrame) -> DataFrame:
    """Joins each row with the least value of its key; a hub's rows are dealt over many tasks."""
    return salted_join(pairs, pairs.groupBy("a").agg(F.min("b").alias("m")), "a", "b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _least(both).withColumn("m", F.least("m", "a"))
    return found.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _least(down)
    near = found.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(found.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Each node of an edge with the least node of its component: node, root. edges: a, b (long, not null).

    Every round is checkpointed; the number of edges never grows, and rounds end as they bring nodes nearer to their
    least neighbours until nothing moves. An edge from a node to itself is ignored.
    """
    now = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # a star forest: no node has two lesser neighbours, and none of these has a lesser one itself
        branched = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low < high").select("a")
        chained = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi")
        if branched.unionByName(chained.select(F.col("b").alias("a"))).isEmpty():
            break
        now = checkpoint(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
