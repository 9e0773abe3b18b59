"""Queries that run a stream to its end and return what it wrote, and the scan of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking, rates
from tessera.plans import views as V
from tessera.plans.views import HOUR, with_sql
from tessera.sources.tree import dealt, opener, read_tree
from tessera.streaming import upkeep
from tessera.streaming.folders import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tree_scan(s, d):
    """The regular files of the tables' folder."""
    return read_tree(s, d, content=False).select("path", "size")


def stage_rates(s, d):
    """How fast the tables' files are read, cut, hashed and sealed here; the rates differ from run to run."""
    files = dealt(read_tree(s, d, content=False).filter("path LIKE 'orders.%' OR path LIKE 'pages.%'"))
    return rates.measured(files, opener((d,)), chunking.Config.of(65536)).select("stage", "bytes", (F.col("rate") > 0).alias("measured"), "rate").orderBy("stage")


def upload_stream(s, d):
    """References streamed as uploads: each chunk is stored once."""
    at = scratch(s, "uploads")
    rows = V.refs(s, d).select("chunk_id", (F.col("chunk_id") % 50).alias("chunk_len"))
    rows.write.parquet(f"{at}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    upkeep.upload(stream, f"{at}/store", f"{at}/log").awaitTermination()
    return s.read.parquet(f"{at}/store")


def gc_stream(s, d):
    """What eight half-hourly runs do to each chunk, as a stateful stream."""
    at = scratch(s, "collection")
    runs = s.range(8).select(F.col("id").alias("r"), (F.col("id") * 1_800_000).alias("run_ms"))
    seen = V.chunk_index(s, d).join(F.broadcast(runs), F.lit(True))  # eight rows
    seen = seen.select("chunk_id", "run_ms", (((F.col("chunk_id") % 5 + F.col("r")) % 4 != 0) & (F.col("chunk_id") % 7 != 0)).alias("zero"))
    seen.write.parquet(f"{at}/in")
    stream = s.readStream.schema(seen.schema).parquet(f"{at}/in")
    before = s.conf.get(_PROVIDER, None)
    s.conf.set(_PROVIDER, _ROCKS)
    out = upkeep.collect(stream, HOUR).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    out.awaitTermination()
    if before is None:
        s.conf.unset(_PROVIDER)
    else:
        s.conf.set(_PROVIDER, before)
    return s.read.parquet(f"{at}/out")


def schedule_runs(s, d):
    """A hundred runs of a three-hourly schedule without jitter."""
    return upkeep.run_times(0, 10_800, 0.0, s.range(1, 101).select(F.col("id").alias("n"), F.lit(0.3).alias("draw")))


QUERIES = {
    "tree_scan": (tree_scan, None),
    "stage_rates": (stage_rates, None),
    "upload_stream": (upload_stream, with_sql("refs") + " SELECT DISTINCT chunk_id, chunk_id % 50 AS chunk_len FROM refs"),
    "gc_stream": (
        gc_stream,
        with_sql("chunk_index").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, seen AS (SELECT chunk_id, r, r * 1800000 AS run_ms, (chunk_id % 5 + r) % 4 <> 0 AND chunk_id % 7 <> 0 AS zero FROM chunk_index, range(8) t(r)),
f AS (SELECT chunk_id, CAST(-1 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS run_ms, CAST(NULL AS BIGINT) AS marked, CAST(NULL AS VARCHAR) AS action FROM chunk_index
UNION ALL SELECT f.chunk_id, s.r, s.run_ms,
CASE WHEN s.zero AND f.marked IS NULL THEN s.run_ms WHEN s.zero AND s.run_ms - f.marked < 3600000 THEN f.marked END,
CASE WHEN NOT s.zero THEN CASE WHEN f.marked IS NOT NULL THEN 'clear' END WHEN f.marked IS NULL THEN 'mark' WHEN s.run_ms - f.marked >= 3600000 THEN 'sweep' ELSE 'wait' END
FROM f JOIN seen s ON s.chunk_id = f.chunk_id AND s.r = f.r + 1)
SELECT chunk_id, run_ms, action FROM f WHERE action IS NOT NULL""",
    ),
    "schedule_runs": (schedule_runs, "SELECT i AS n, (i - 1) * 10800000 AS run_ms FROM range(1, 101) t(i)"),
}
