"""The corpus pipeline: each stage works on what its predecessor kept, and all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_join, quality, sharding
from tessera.llm._cluster import drop_dir, fresh_dir
from tessera.plans.views import spread


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    docs = spread(docs)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_join.deduplicated(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: documents repeated, cut or left out as their blocks are drawn."""
    return mixing.mixed(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("benchmark decontamination", stage_decontaminate),
    ("mixing sources to target weights", stage_mix),
    ("sharding", stage_shard),
]
#: Trained scores and drawn blocks are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table.

    What each stage keeps is written to the shared folder, and goes from there when the next stage is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = fresh_dir(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_dir(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
