"""Queries over chunks: sizing, overlap, ledgers, offsets and reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import chunking, dedup, restore, sizing
from tessera.plans import views as V
from tessera.plans.views import with_sql

#: Cut rates that stand for candidate sizes.
RATES = (4, 16, 256)
SNAPSHOTS = 36


def _chunk_sql(name: str, source: str, rate: int) -> str:
    return f"""{name} AS (SELECT path, CAST(k - 1 AS BIGINT) AS seq, body, md5(body) AS chunk_id, CAST(octet_length(encode(body)) AS BIGINT) AS len FROM (
SELECT path, k, array_to_string(w[coalesce(ends[k - 1], 0) + 1:ends[k]], ' ') AS body FROM (
SELECT path, w, ends, unnest(range(1, len(ends) + 1)) AS k FROM (
SELECT path, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR cut[i]) AS ends FROM (
SELECT path, w, list_transform(w, lambda x, i: md5(CASE WHEN i = 1 THEN x ELSE w[i - 1] || ' ' || x END) < '{chunking.threshold(rate)}') AS cut FROM (SELECT path, string_split(text, ' ') AS w FROM {source}))))))"""


def _sized(tree: DataFrame) -> DataFrame:
    """One set of chunks for each rate."""
    return chunking.word_chunks(tree, *RATES)


def _chunks(tree: DataFrame, rate: int) -> DataFrame:
    return chunking.word_chunks(tree, rate).drop("target_size")


def _files(tree: DataFrame) -> DataFrame:
    return tree.select("path", F.octet_length("text").cast("long").alias("size"))


def chunk_words(s, d):
    return _chunks(V.files(s, d).select("path", "text"), 16)


def sizing_report(s, d):
    """The flagship: chunk two versions at each rate, and report sizes, percentiles, projections and overlap."""
    now, was = V.tree(s, d, "current"), V.tree(s, d, "baseline")
    return sizing.report(_files(now), _sized(now), SNAPSHOTS, _sized(was)).orderBy("target_size")


def recommend_size(s, d):
    return sizing.recommend(sizing_report(s, d).select("target_size", "cost"))


def chunk_percentiles(s, d):
    """Nearest-rank percentiles of document sizes in each source."""
    docs = V.table(s, d, "documents")
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return docs.groupBy("source").agg(*ranks)


def manifest_bytes(s, d):
    now = V.tree(s, d, "all")
    return sizing.manifest_bytes(_files(now), _sized(now))


def baseline_overlap(s, d):
    both = [_chunks(V.tree(s, d, side), 16) for side in ("current", "baseline")]
    return dedup.overlap(*both).withColumn("overlap_pct", F.round("overlap_pct", 6))


def baseline_delta(s, d):
    both = [_chunks(V.tree(s, d, side), 16) for side in ("current", "baseline")]
    return dedup.delta(*both)


def shared_ids(s, d):
    """Ids in both trees, by set intersection."""
    both = [_chunks(V.tree(s, d, side), 16).select("chunk_id") for side in ("current", "baseline")]
    return both[0].intersect(both[1])


def unique_ids(s, d):
    return dedup.unique(_chunks(V.tree(s, d, "all"), 16)).select("chunk_id")


def first_occurrence(s, d):
    return dedup.first_occurrence(_chunks(V.tree(s, d, "all"), 16))


def backup_ledger(s, d):
    now, was = V.tree(s, d, "current"), V.tree(s, d, "baseline")
    return dedup.ledger(_files(now), _chunks(now, 16), dedup.unique(_chunks(was, 16)))


def ship_partition(s, d):
    now, was = V.tree(s, d, "current"), V.tree(s, d, "baseline")
    return dedup.shipped(_chunks(now, 16), dedup.unique(_chunks(was, 16))).groupBy("ship").agg(F.count("*").alias("chunks"), F.sum("len").cast("long").alias("bytes"))


def chunk_offsets(s, d):
    return dedup.with_offsets(_chunks(V.tree(s, d, "all"), 16)).select("path", "seq", "offset", "len")


def file_sizes(s, d):
    """Each file's bytes as the sum of its chunks."""
    return _chunks(V.tree(s, d, "all"), 16).groupBy("path").agg(F.sum("len").cast("long").alias("file_bytes"), F.count("*").alias("chunks"))


def scan_totals(s, d):
    return V.files(s, d).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def scan_union(s, d):
    """Two roots as one tree, each under its name."""
    trees = [_files(V.tree(s, d, side)) for side in ("current", "baseline")]
    return dedup.united(trees, ["current", "baseline"])


def file_orders(s, d):
    """Places of files by whole path and by directory, which differ."""
    rows = V.files(s, d).select(F.element_at(F.split("path", "/"), 1).alias("root"), "path")
    rows = rows.withColumn("path", F.when(F.md5("path") < "5", F.regexp_replace("path", "/([^/]*)$", ".$1")).otherwise(F.col("path")))
    return dedup.places(rows).select("path", "by_path", "by_directory")


def restore_assemble(s, d):
    """Files put together from their chunks; the hash of the content is that of the text."""
    tree = V.tree(s, d, "all").select("path", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int"))).alias("seq"), "text")
    parts = tree.select("path", "seq", F.substring(F.col("text"), F.col("seq") * 500 + 1, F.lit(500)).alias("data")).withColumn("chunk_id", F.md5("data"))
    held = parts.select("chunk_id", "data").dropDuplicates(["chunk_id"])
    return restore.assembled(parts.select("path", "seq", "chunk_id"), held).select("path", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("chars"), "missing")


def integrity_check(s, d):
    """Outcomes of reading chunks of which some are gone, short or altered."""
    from tessera.operators import store

    docs = V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wanted = docs.select(F.sha2("text", 256).alias("chunk_id"), F.octet_length("text").alias("chunk_len"), "doc_id", "text")
    wanted = wanted.groupBy("chunk_id").agg(F.first("chunk_len").alias("chunk_len"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    k = F.col("doc_id") % 10
    data = F.when(k == 1, F.expr("substring(text, 1, length(text) - 1)")).when(k == 2, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    objects = wanted.filter(k != 0).select("chunk_id", data.cast("binary").alias("data"))
    return store.verified(wanted.select("chunk_id", "chunk_len"), objects)


def restore_checks(s, d):
    """The first thing wrong with each file's answers."""
    lines = V.refs(s, d)
    got = lines.select(
        F.concat(F.when(F.col("snapshot_id") % 19 == 0, F.lit("../")).otherwise(F.lit("f/")), F.col("snapshot_id").cast("string")).alias("path"),
        (F.col("seq") - 1 + F.when(F.col("snapshot_id") % 17 == 0, 1).otherwise(0)).alias("seq"),
        F.col("chunk_id").alias("asked_id"),
        F.when(F.col("snapshot_id") % 13 == 0, None).when(F.col("snapshot_id") % 11 == 0, F.col("chunk_id") + 1).otherwise(F.col("chunk_id")).alias("sent_id"),
        F.when(F.col("snapshot_id") % 11 == 0, F.col("chunk_id") + 1).when(F.col("snapshot_id") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("chunk_id")).alias("real_id"),
        (F.col("chunk_id") % 100).alias("len"),
    )
    # numbered anew, as the table's line numbers may repeat
    from pyspark.sql import Window as W

    got = got.withColumn("seq", F.row_number().over(W.partitionBy("path").orderBy("seq", "asked_id")) - 1 + F.when(F.element_at(F.split("path", "/"), -1).cast("long") % 17 == 0, 1).otherwise(0))
    files = got.groupBy("path").agg((F.sum("len") + F.when(F.element_at(F.split("path", "/"), -1).cast("long") % 5 == 0, 1).otherwise(0)).alias("size"))
    return restore.checked(files, got)


def restore_totals(s, d):
    outcomes = restore_checks(s, d)
    files = outcomes.select("path", F.length("path").cast("long").alias("size"))
    return restore.restore_ledger(outcomes, files)


def manifest_refs(s, d):
    """References of nested manifests in order, repeats kept."""
    lines = V.table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("string").cast("binary"))).alias("chunks"))
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("path"), F.lit(0).cast("long").alias("size"), "chunks"))).alias("files"))
    manifests = files.select(F.col("l_orderkey").alias("snapshot_id"), "files")
    return restore.exploded(manifests).select("snapshot_id", "path", "file_no", "chunk_no", F.col("chunk_id").cast("string").alias("chunk_id"))


def manifest_codec(s, d):
    """Manifests as bytes: their lengths, what they hold, and whether reading them back gives the same."""
    lines = V.table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.array_sort(F.collect_list(F.unhex(F.sha2(F.col("l_partkey").cast("string"), 256)))).alias("chunks"), F.sum("l_quantity").cast("long").alias("size"))
    path = F.concat(F.lit("ü/"), F.col("l_suppkey").cast("string"))
    file = F.struct(path.alias("path"), "size", (F.col("l_suppkey") - 50).alias("mtime_secs"), (F.col("l_suppkey") % 10**9).alias("mtime_nanos"), F.lit(0o100644).cast("long").alias("mode"), "chunks")
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(file)).alias("files"))
    made = made.select(F.unhex(F.lpad(F.hex("l_orderkey"), 32, "0")).alias("snapshot_id"), F.col("l_orderkey").cast("long").alias("created_at"), "files")
    blobs = restore.encoded(made)
    back = restore.decoded(blobs).select("snapshot_id", F.xxhash64("created_at", "files").alias("after"))
    sums = made.select("snapshot_id", "created_at", F.xxhash64("created_at", "files").alias("before"), F.size("files").cast("long").alias("files"), F.aggregate("files", F.lit(0).cast("long"), lambda n, x: n + F.size(x["chunks"])).alias("chunks"))
    rows = sums.join(blobs.select("snapshot_id", F.octet_length("blob").cast("long").alias("bytes")), "snapshot_id").join(back, "snapshot_id")
    return rows.select(F.col("created_at").alias("snapshot_id"), "files", "chunks", "bytes", (F.col("before") == F.col("after")).alias("same"))


def packed_refs(s, d):
    """Ids side by side in one value, taken apart."""
    ids = V.refs(s, d).select("snapshot_id", F.sha2(F.col("chunk_id").cast("string"), 256).alias("id"))
    packed = ids.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("snapshot_id", F.unhex(F.array_join("ids", "")).alias("refs"))
    return restore.unpacked(packed).select("snapshot_id", F.col("seq").cast("long").alias("seq"), formats.id_hex(F.col("chunk_id")).alias("chunk_id"))


def cdc_fanout(s, d):
    """The byte chunker over all documents at three sizes."""
    files = V.files(s, d).select("path", F.col("text").cast("binary").alias("content"))
    return chunking.chunked(files, [256, 512, 1024])


def cdc_report(s, d):
    """The sizing report over byte chunks."""
    files = V.files(s, d)
    return sizing.report(files.select("path", "size"), cdc_fanout(s, d), SNAPSHOTS)


def upload_batches(s, d):
    """Batch cuts along each user's events, at most 8 events or 300 in value."""
    rows = V.events(s, d).select(F.col("user_id").cast("string").alias("root"), F.col("event_id").alias("seq"), F.abs(F.round("value")).cast("long").alias("len"))
    return dedup.batches(rows, 8, 300)


_BOTH = with_sql("current_tree", "baseline_tree") + ", " + ", ".join(_chunk_sql(f"{n}{r}", f"{n}_tree", r) for n in ("current", "baseline") for r in RATES)
_C16 = with_sql("all_tree") + ", " + _chunk_sql("c", "all_tree", 16)
_CB = with_sql("current_tree", "baseline_tree") + ", " + _chunk_sql("c", "current_tree", 16) + ", " + _chunk_sql("b", "baseline_tree", 16)
_REPORT = (
    _BOTH
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS t, chunk_id, len FROM current{r}" for r in RATES)
    + "), b AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT CAST({r} AS BIGINT) AS t, chunk_id FROM baseline{r}" for r in RATES)
    + f"""), u AS (SELECT t, chunk_id, max(len) AS len, count(*) AS n FROM c GROUP BY t, chunk_id),
s AS (SELECT u.t, CAST(sum(n) AS BIGINT) AS total_chunks, count(*) AS unique_chunks, CAST(sum(u.len * n) AS BIGINT) AS total_bytes, CAST(sum(u.len) AS BIGINT) AS unique_bytes, count(b.chunk_id) AS shared FROM u LEFT JOIN b ON u.t = b.t AND u.chunk_id = b.chunk_id GROUP BY u.t),
q AS (SELECT t, quantile_disc(len, 0.5) AS p50, quantile_disc(len, 0.95) AS p95, count(*) AS n FROM c GROUP BY t),
f AS (SELECT count(*) AS files, sum(octet_length(encode(path))) AS path_bytes FROM current_tree),
m AS (SELECT q.t, CAST(28 + 32 * files + path_bytes + 32 * n AS BIGINT) AS manifest_bytes FROM q, f),
r AS (SELECT s.t AS target_size, total_chunks, unique_chunks, total_bytes, unique_bytes, round(total_bytes / unique_bytes, 6) AS dedup_ratio, round(total_bytes / total_chunks, 6) AS mean_len, CAST(p50 AS BIGINT) AS p50, CAST(p95 AS BIGINT) AS p95, CAST(unique_chunks * 48 AS BIGINT) AS index_bytes, manifest_bytes, CAST(unique_chunks * 48 + {SNAPSHOTS} * manifest_bytes AS BIGINT) AS bookkeeping_bytes, CAST(unique_chunks * 48 + {SNAPSHOTS} * manifest_bytes + unique_bytes AS BIGINT) AS cost, round(shared / unique_chunks * 100, 6) AS overlap_pct FROM s JOIN q ON s.t = q.t JOIN m ON s.t = m.t)"""
)

QUERIES = {
    "chunk_words": (chunk_words, with_sql("files") + ", " + _chunk_sql("c", "files", 16) + " SELECT path, seq, chunk_id, len FROM c"),
    "sizing_report": (sizing_report, _REPORT + " SELECT * FROM r"),
    "recommend_size": (recommend_size, _REPORT + " SELECT target_size, cost FROM r ORDER BY cost, target_size LIMIT 1"),
    "chunk_percentiles": (chunk_percentiles, "SELECT source, " + ", ".join(f"CAST(quantile_disc(n_chars, {p}) AS BIGINT) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM documents GROUP BY source"),
    "manifest_bytes": (
        manifest_bytes,
        with_sql("all_tree") + "".join(", " + _chunk_sql(f"c{r}", "all_tree", r) for r in RATES) + ", n AS (" + " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS t, count(*) AS n FROM c{r}" for r in RATES) + "), f AS (SELECT count(*) AS files, sum(octet_length(encode(path))) AS path_bytes FROM all_tree) SELECT t AS target_size, CAST(28 + 32 * files + path_bytes + 32 * n AS BIGINT) AS manifest_bytes FROM n, f",
    ),
    "baseline_overlap": (baseline_overlap, _CB + ", u AS (SELECT DISTINCT chunk_id FROM c) SELECT count(*) AS unique_chunks, count(*) FILTER (x) AS shared_chunks, round(count(*) FILTER (x) / count(*) * 100, 6) AS overlap_pct FROM (SELECT chunk_id IN (SELECT chunk_id FROM b) AS x FROM u)"),
    "baseline_delta": (baseline_delta, _CB + " SELECT DISTINCT chunk_id, len FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM b)"),
    "shared_ids": (shared_ids, _CB + " SELECT chunk_id FROM c INTERSECT SELECT chunk_id FROM b"),
    "unique_ids": (unique_ids, _C16 + " SELECT DISTINCT chunk_id FROM c"),
    "first_occurrence": (first_occurrence, _C16 + " SELECT chunk_id, path, seq, len FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY path, seq) AS k FROM c) WHERE k = 1"),
    "backup_ledger": (
        backup_ledger,
        _CB + ", u AS (SELECT chunk_id, max(len) AS len, max(chunk_id) NOT IN (SELECT chunk_id FROM b) AS ship FROM c GROUP BY chunk_id) SELECT (SELECT count(*) FROM current_tree) AS files, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM current_tree) AS source_bytes, (SELECT count(*) FROM c) AS chunks_total, count(*) AS chunks_unique, count(*) FILTER (ship) AS chunks_uploaded, count(*) FILTER (NOT ship) AS chunks_deduped, CAST(coalesce(sum(len + 41) FILTER (ship), 0) AS BIGINT) AS upload_bytes FROM u",
    ),
    "ship_partition": (ship_partition, _CB + ", u AS (SELECT chunk_id, max(len) AS len, max(chunk_id) NOT IN (SELECT chunk_id FROM b) AS ship FROM c GROUP BY chunk_id) SELECT ship, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes FROM u GROUP BY ship"),
    "chunk_offsets": (chunk_offsets, _C16 + ' SELECT path, seq, CAST(coalesce(sum(len) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", len FROM c'),
    "file_sizes": (file_sizes, _C16 + " SELECT path, CAST(sum(len) AS BIGINT) AS file_bytes, count(*) AS chunks FROM c GROUP BY path"),
    "scan_totals": (scan_totals, with_sql("files") + " SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files"),
    "scan_union": (scan_union, with_sql("current_tree", "baseline_tree") + " SELECT 'current/' || path AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM current_tree UNION ALL SELECT 'baseline/' || path, CAST(octet_length(encode(text)) AS BIGINT) FROM baseline_tree"),
    "file_orders": (
        file_orders,
        with_sql("files") + r", r AS (SELECT split_part(path, '/', 1) AS root, CASE WHEN md5(path) < '5' THEN regexp_replace(path, '/([^/]*)$', '.\1') ELSE path END AS path FROM files) SELECT path, row_number() OVER (PARTITION BY root ORDER BY path) AS by_path, row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/'), path) AS by_directory FROM r",
    ),
    "restore_assemble": (restore_assemble, with_sql("all_tree") + " SELECT path, md5(text) AS content_md5, CAST(length(text) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS missing FROM all_tree"),
    "integrity_check": (
        integrity_check,
        "WITH w AS (SELECT sha256(coalesce(text, '')) AS chunk_id, min(doc_id) AS i, any_value(coalesce(text, '')) AS t FROM documents GROUP BY 1) SELECT chunk_id, CASE WHEN i % 10 = 0 THEN 'missing' WHEN i % 10 = 1 AND t <> '' THEN 'length_mismatch' WHEN i % 10 = 2 AND octet_length(encode(t)) <> octet_length(encode('#' || substr(t, 2))) THEN 'length_mismatch' WHEN i % 10 = 2 AND t <> '#' || substr(t, 2) THEN 'hash_mismatch' ELSE 'ok' END AS outcome FROM w",
    ),
    "restore_checks": (
        restore_checks,
        with_sql("refs") + ", i AS (SELECT DISTINCT snapshot_id AS k FROM refs) SELECT CASE WHEN k % 19 = 0 THEN '../' ELSE 'f/' END || CAST(k AS VARCHAR) AS path, CASE WHEN k % 19 = 0 THEN 'unsafe_path' WHEN k % 17 = 0 THEN 'out_of_order' WHEN k % 13 = 0 THEN 'missing_chunk' WHEN k % 11 = 0 THEN 'wrong_chunk' WHEN k % 7 = 0 THEN 'hash_mismatch' WHEN k % 5 = 0 THEN 'size_mismatch' ELSE 'ok' END AS outcome FROM i",
    ),
    "restore_totals": (
        restore_totals,
        with_sql("refs") + ", i AS (SELECT DISTINCT snapshot_id AS k FROM refs), o AS (SELECT k % 19 <> 0 AND k % 17 <> 0 AND k % 13 <> 0 AND k % 11 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 AS ok, length(CAST(k AS VARCHAR)) + 2 AS size FROM i) SELECT count(*) FILTER (ok) AS files, CAST(sum(size) FILTER (ok) AS BIGINT) AS bytes, count(*) FILTER (NOT ok) AS failed FROM o",
    ),
    "manifest_refs": (
        manifest_refs,
        "WITH l AS (SELECT l_orderkey AS snapshot_id, CAST(l_suppkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS chunk_id FROM lineitem) SELECT snapshot_id, path, CAST(dense_rank() OVER (PARTITION BY snapshot_id ORDER BY path) - 1 AS INTEGER) AS file_no, CAST(row_number() OVER (PARTITION BY snapshot_id, path ORDER BY chunk_id) - 1 AS INTEGER) AS chunk_no, chunk_id FROM l",
    ),
    "manifest_codec": (
        manifest_codec,
        "WITH f AS (SELECT l_orderkey AS k, l_suppkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(k AS BIGINT) AS snapshot_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, CAST(28 + sum(32 + 3 + length(CAST(p AS VARCHAR)) + 32 * n) AS BIGINT) AS bytes, true AS same FROM f GROUP BY k",
    ),
    "packed_refs": (packed_refs, with_sql("refs") + ", i AS (SELECT snapshot_id, sha256(CAST(chunk_id AS VARCHAR)) AS chunk_id FROM refs) SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY chunk_id) - 1 AS seq, chunk_id FROM i"),
    "cdc_fanout": (cdc_fanout, None),
    "cdc_report": (cdc_report, None),
    "upload_batches": (
        upload_batches,
        with_sql("events_").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, l AS (SELECT user_id, event_id AS seq, CAST(abs(round(value)) AS BIGINT) AS len, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events_),
f AS (SELECT user_id, seq, len, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, len AS size FROM l WHERE k = 1
UNION ALL SELECT l.user_id, l.seq, l.len, l.k, f.batch + CASE WHEN f.n >= 8 OR f.size >= 300 THEN 1 ELSE 0 END, CASE WHEN f.n >= 8 OR f.size >= 300 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 8 OR f.size >= 300 THEN l.len ELSE f.size + l.len END FROM f JOIN l ON l.user_id = f.user_id AND l.k = f.k + 1)
SELECT CAST(user_id AS VARCHAR) AS root, seq, len, batch FROM f""",
    ),
}
