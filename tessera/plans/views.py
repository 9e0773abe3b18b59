"""The store's relations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
#: The time that plans over the orders look back from: 2001-08-02 00:00:00 UTC.
NOW_MS = 996_710_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows anew where a table comes in fewer parts than there are cores, as a small single file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def snapshots(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), _ms("o_orderdate").alias("time_ms"), F.col("o_custkey").alias("owner"))


def refs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_partkey").alias("chunk_id"))


def chunk_index(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("long").alias("chunk_len"))


def clients(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("client-"), (F.col("c_custkey") % 900).cast("string")).alias("name"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("fingerprint"), (F.col("c_custkey") % 7 == 0).alias("revoked"))


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", _ms("ts").alias("at_ms"), "user_id", "event_type", "value")


def files(spark, d) -> DataFrame:
    """Documents, pages and conversations as files."""
    ext = F.get(F.array(*map(F.lit, ["txt", "docx", "PDF", "png", "sqlite", "bin"])), (F.col("doc_id") % 6).cast("int"))
    docs = spread(table(spark, d, "documents")).select(F.concat_ws("/", "lang", "source", F.concat_ws(".", F.col("doc_id").cast("string"), ext)).alias("path"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    talks = table(spark, d, "conversations").select(F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("path"), "text")
    return docs.unionByName(pages).unionByName(talks).select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def tree(spark, d, side: str) -> DataFrame:
    """All documents, or two versions of them: `current` lacks a tenth and alters a tenth of the `baseline`."""
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    if side == "current":
        docs = docs.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat(F.col("text"), F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    elif side == "baseline":
        docs = docs.filter("doc_id % 10 <> 9")
    return docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")


#: The same relations in DuckDB's SQL.
SQL = {
    "snapshots": "snapshots AS (SELECT o_orderkey AS snapshot_id, (epoch_us(o_orderdate) // 1000) AS time_ms, o_custkey AS owner FROM orders)",
    "refs": "refs AS (SELECT l_orderkey AS snapshot_id, l_linenumber AS seq, l_partkey AS chunk_id FROM lineitem)",
    "chunk_index": "chunk_index AS (SELECT p_partkey AS chunk_id, CAST(p_size AS BIGINT) AS chunk_len FROM part)",
    "clients": "clients AS (SELECT 'client-' || CAST(c_custkey % 900 AS VARCHAR) AS name, sha256(CAST(c_custkey AS VARCHAR)) AS fingerprint, c_custkey % 7 = 0 AS revoked FROM customer)",
    "events_": "events_ AS (SELECT event_id, (epoch_us(ts) // 1000) AS at_ms, user_id, event_type, value FROM events)",
    "files": """files AS (SELECT path, coalesce(text, '') AS text, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size FROM (
SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.' || (['txt', 'docx', 'PDF', 'png', 'sqlite', 'bin'])[CAST(doc_id % 6 + 1 AS INTEGER)] AS path, text FROM documents
UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html', html FROM pages
UNION ALL SELECT 'talks/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations))""",
    "current_tree": "current_tree AS (SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') || CASE WHEN doc_id % 10 = 1 THEN ' ' || CAST(doc_id AS VARCHAR) ELSE '' END AS text FROM documents WHERE doc_id % 10 <> 0)",
    "all_tree": "all_tree AS (SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents)",
    "baseline_tree": "baseline_tree AS (SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 9)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
