"""Queries over retention and the store's relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import dedup, retention, store
from tessera.plans import views as V
from tessera.plans.views import HOUR, NOW_MS, with_sql

NOW = F.lit
DAY = 24 * HOUR

#: Tier and cell of a time in SQL; {t} is the time's column and {now} the clock.
_TIER = "CASE WHEN greatest({now} - {t}, 0) < 86400000 THEN 0 WHEN greatest({now} - {t}, 0) < 345600000 THEN 1 WHEN greatest({now} - {t}, 0) < 1382400000 THEN 2 ELSE 3 END"
_WIDTH = "CASE tier WHEN 0 THEN 10800000 WHEN 1 THEN 86400000 WHEN 2 THEN 345600000 ELSE 1382400000 END"


def _plan_sql(source: str, now: str, by: str = "") -> str:
    part = f"{by}, " if by else ""
    return f"""tiered AS (SELECT *, {_TIER.format(now=now, t="time_ms")} AS tier FROM {source}),
celled AS (SELECT *, CAST(floor(time_ms / ({_WIDTH})) AS BIGINT) AS cell FROM tiered),
planned AS (SELECT *, row_number() OVER (PARTITION BY {part}tier, cell ORDER BY time_ms DESC, snapshot_id DESC) = 1 AS keep FROM celled)"""


def retention_plan(s, d):
    return retention.plan(V.snapshots(s, d), NOW(NOW_MS)).select("snapshot_id", "time_ms", "tier", "cell", "keep")


def retention_survivors(s, d):
    return retention.survivors(V.snapshots(s, d), NOW(NOW_MS))


def retention_per_owner(s, d):
    rows = V.events(s, d).select(F.col("event_id").alias("snapshot_id"), F.col("at_ms").alias("time_ms"), F.col("user_id").alias("owner"))
    newest = rows.agg(F.max("time_ms").alias("now_ms"))
    kept = retention.plan(rows.join(F.broadcast(newest), F.lit(True)), F.col("now_ms"), by=("owner",))  # one row
    return kept.groupBy("owner", "tier").agg(F.count("*").alias("snapshots"), F.count_if("keep").alias("kept"))


def retention_plan_sim481(s, d):
    rows = s.range(481).select(F.col("id").alias("snapshot_id"), (F.col("id") * 3 * HOUR).alias("time_ms"))
    return retention.plan(rows, NOW(480 * 3 * HOUR)).filter("keep").select("snapshot_id", "tier")


def retention_partition(s, d):
    """Kept and dropped rows are disjoint and are all rows."""
    p = retention.plan(V.snapshots(s, d), NOW(NOW_MS))
    return p.agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.count("*").alias("total"))


def tier_lookup(s, d):
    ages = s.range(0, 500).select((F.col("id") * HOUR).alias("age_ms"))
    return ages.select("age_ms", retention.tier_of(F.col("age_ms")).cast("int").alias("tier"))


def tier_order_check(s, d):
    """Tiers whose age falls below the one before: none in a sound policy."""
    from pyspark.sql import Window as W

    before = F.lag("max_age_ms").over(W.orderBy("tier"))  # a handful of tiers
    return retention.tiers(s).withColumn("before", before).select("tier", (F.coalesce(F.col("max_age_ms") >= F.col("before"), F.lit(True)) & (F.col("cell_ms") > 0)).alias("ok"))


def steady_state_occupancy(s, d):
    return retention.occupancy(s.range(0, 400).select(F.col("id").alias("days")))


def retention_cells(s, d):
    """The three-hour cell of each event, aligned to the epoch."""
    return V.events(s, d).select("event_id", ((F.col("at_ms") - F.pmod("at_ms", F.lit(3 * HOUR))) / (3 * HOUR)).cast("long").alias("cell"))


def refcounts(s, d):
    return store.refcounts(V.chunk_index(s, d), V.refs(s, d))


def zero_ref_chunks(s, d):
    p, r = store.prune(V.snapshots(s, d), V.refs(s, d), NOW(NOW_MS))
    return store.zero_ref(V.chunk_index(s, d), r)


def store_status(s, d):
    return store.status(V.snapshots(s, d), V.refs(s, d), V.chunk_index(s, d))


def snapshots_by_owner(s, d):
    owned = V.snapshots(s, d).withColumn("owner", F.when(F.col("owner") % 10 == 0, None).otherwise(F.col("owner")))
    return store.by_owner(owned)


def owner_map(s, d):
    """The owners' counts as one map's text, in key order."""
    owned = V.snapshots(s, d).withColumn("owner", F.col("owner") % 12)
    pairs = F.array_sort(F.collect_list(F.struct("owner", "snapshots")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["owner"], x["snapshots"].cast("string"))), ",")
    return store.by_owner(owned).agg(text.alias("owners"))


def fk_violations(s, d):
    index = V.chunk_index(s, d).filter("chunk_id % 13 <> 0")
    return store.unknown_refs(V.refs(s, d), index).select("snapshot_id", "seq", "chunk_id")


def prune_then_refcount(s, d):
    _, r = store.prune(V.snapshots(s, d), V.refs(s, d), NOW(NOW_MS))
    return store.refcounts(V.chunk_index(s, d), r).groupBy("refcount").agg(F.count("*").alias("chunks"), F.sum("chunk_len").cast("long").alias("bytes"))


def _marks(s, d):
    return V.chunk_index(s, d).filter("chunk_id % 3 <> 0").select("chunk_id", (F.lit(NOW_MS) - (F.col("chunk_id") % 5) * 1_800_000).alias("marked_ms"))


def gc_reconcile(s, d):
    _, r = store.prune(V.snapshots(s, d), V.refs(s, d), NOW(NOW_MS))
    return store.gc_step(V.chunk_index(s, d), r, _marks(s, d), NOW_MS, HOUR)


def gc_outcome(s, d):
    return store.gc_outcome(gc_reconcile(s, d))


def gc_runs(s, d):
    """Marks and sweeps of eight hourly runs folded for each chunk; a chunk is seen unreferenced by a rule."""
    runs = s.range(8).select((F.col("id") * 1_800_000).alias("run_ms"), F.col("id").alias("r"))
    seen = V.chunk_index(s, d).join(F.broadcast(runs), F.lit(True))  # eight rows
    seen = seen.withColumn("zero", ((F.col("chunk_id") % 5 + F.col("r")) % 4 != 0) & (F.col("chunk_id") % 7 != 0))
    return store.gc_history(seen.select("chunk_id", "run_ms", "zero"), HOUR)


def last_events(s, d):
    rows = V.events(s, d).select(F.col("event_type").alias("kind"), "at_ms", F.col("event_id").cast("string").alias("detail"))
    return store.last_events(rows)


def latest_n_snapshots(s, d):
    return store.latest(V.snapshots(s, d), 5).select("snapshot_id", "time_ms")


def snapshot_listing(s, d):
    return store.listed(V.snapshots(s, d))


def has_chunks(s, d):
    asked = V.refs(s, d).select((F.col("snapshot_id") * 10 + F.col("seq")).alias("pos"), "chunk_id")
    return store.missing(asked, V.chunk_index(s, d).filter("chunk_id % 4 <> 1"))


def put_chunks(s, d):
    incoming = V.refs(s, d).select("chunk_id", (F.col("chunk_id") % 50).alias("chunk_len"))
    return store.put_chunks(V.chunk_index(s, d).filter("chunk_id % 4 <> 1"), incoming)


def upload_ack(s, d):
    return store.acknowledged(V.chunk_index(s, d).filter("chunk_id % 4 <> 1"), V.refs(s, d).select("chunk_id"))


def put_snapshots(s, d):
    """Which snapshots a store that holds a fifth of them, and not all of their chunks, takes."""
    every = V.snapshots(s, d)
    return store.put_outcomes(every.filter("snapshot_id % 5 = 0"), V.chunk_index(s, d).filter("chunk_id % 29 <> 0"), every.select("snapshot_id"), V.refs(s, d))


def delete_snapshot(s, d):
    gone = V.snapshots(s, d).filter("snapshot_id % 17 = 0").select("snapshot_id")
    left, refs = store.delete_snapshots(V.snapshots(s, d), V.refs(s, d), gone)
    return store.refcounts(V.chunk_index(s, d), refs).agg(F.sum("refcount").cast("long").alias("refs"), F.count_if(F.col("refcount") == 0).alias("zero"), F.max("refcount").alias("most"))


def delete_chunk(s, d):
    _, r = store.prune(V.snapshots(s, d), V.refs(s, d), NOW(NOW_MS))
    wanted = V.chunk_index(s, d).select((F.col("chunk_id") * 2).alias("chunk_id"))
    return store.deletable(V.chunk_index(s, d), r, wanted)


def chunk_lookup(s, d):
    return store.lookup(V.chunk_index(s, d), 42)


def client_auth_status(s, d):
    seen = s.range(0, 2000).select(F.sha2((F.col("id") * 3).cast("string"), 256).alias("fingerprint"))
    return store.authenticated(seen, V.clients(s, d))


def client_repeated_names(s, d):
    return store.repeated_names(V.clients(s, d))


def client_revoke(s, d):
    _, changed = store.revoke(V.clients(s, d), "client-10")
    return V.clients(s, d).agg(changed.alias("changed"))


def client_names(s, d):
    rows = V.table(s, d, "customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 11 == 0, F.concat(F.col("c_name"), F.lit("\t"))).when(F.col("c_custkey") % 13 == 0, F.repeat("c_name", 9)).otherwise(F.col("c_name")).alias("name"))
    return rows.select("c_custkey", formats.usable_name(F.col("name")).alias("usable"))


def token_spend(s, d):
    shown = V.events(s, d).select(F.col("event_id").alias("pos"), (F.col("event_id") % 97).alias("token"))
    tokens = s.range(0, 80).select(F.col("id").alias("token"))
    return store.spend(tokens, shown)


def phase_detection(s, d):
    """For stores that hold other parts of the snapshots: initial for a store without any, whoever owns them, else incremental."""
    rows = V.snapshots(s, d).select((F.col("snapshot_id") % 3).alias("store"))
    stores = s.range(5).select(F.col("id").alias("store"))
    any_ = rows.distinct().withColumn("had", F.lit(True))
    return stores.join(any_, "store", "left").select("store", F.when(F.col("had"), "incremental").otherwise("initial").alias("phase"))


def progress_throttle(s, d):
    """Ticks of each user's events that are shown, at most one in six hours."""
    ticks = V.events(s, d).select(F.col("user_id").alias("run"), "at_ms")
    return dedup.throttled(ticks, 6 * HOUR).groupBy("run").agg(F.count("*").alias("shown"), F.max("at_ms").alias("last_ms"))


def running_progress(s, d):
    rows = V.files(s, d).select(F.element_at(F.split("path", "/"), 1).alias("root"), "path", "size")
    return dedup.progress(rows, "path").select("path", "files_done", "bytes_done")


_PRUNED = "kept_refs AS (SELECT r.* FROM refs r JOIN planned p USING (snapshot_id) WHERE p.keep)"
_STORE = with_sql("snapshots", "refs", "chunk_index") + ", " + _plan_sql("snapshots", str(NOW_MS)) + ", " + _PRUNED
_GC = _STORE + f""", zero AS (SELECT chunk_id, chunk_len FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM kept_refs)),
marks AS (SELECT chunk_id, {NOW_MS} - (chunk_id % 5) * 1800000 AS marked_ms FROM chunk_index WHERE chunk_id % 3 <> 0),
step AS (SELECT coalesce(z.chunk_id, m.chunk_id) AS chunk_id, z.chunk_len, CASE WHEN z.chunk_id IS NULL THEN 'clear' WHEN m.chunk_id IS NULL THEN 'mark' WHEN {NOW_MS} - m.marked_ms >= 3600000 THEN 'sweep' ELSE 'wait' END AS action, coalesce(m.marked_ms, {NOW_MS}) AS marked_ms FROM zero z FULL OUTER JOIN marks m ON z.chunk_id = m.chunk_id)"""

QUERIES = {
    "retention_plan": (retention_plan, with_sql("snapshots") + ", " + _plan_sql("snapshots", str(NOW_MS)) + " SELECT snapshot_id, time_ms, CAST(tier AS INTEGER) AS tier, cell, keep FROM planned"),
    "retention_survivors": (retention_survivors, with_sql("snapshots") + ", " + _plan_sql("snapshots", str(NOW_MS)) + " SELECT snapshot_id, time_ms, CAST(tier AS INTEGER) AS tier, cell FROM planned WHERE keep"),
    "retention_per_owner": (
        retention_per_owner,
        "WITH source AS (SELECT event_id AS snapshot_id, (epoch_us(ts) // 1000) AS time_ms, user_id AS owner, (SELECT max((epoch_us(ts) // 1000)) FROM events) AS now_ms FROM events), "
        + _plan_sql("source", "now_ms", "owner")
        + " SELECT owner, CAST(tier AS INTEGER) AS tier, count(*) AS snapshots, count(*) FILTER (keep) AS kept FROM planned GROUP BY owner, tier",
    ),
    "retention_plan_sim481": (
        retention_plan_sim481,
        f"WITH source AS (SELECT i AS snapshot_id, i * {3 * HOUR} AS time_ms FROM range(481) t(i)), " + _plan_sql("source", str(480 * 3 * HOUR)) + " SELECT snapshot_id, CAST(tier AS INTEGER) AS tier FROM planned WHERE keep",
    ),
    "retention_partition": (retention_partition, with_sql("snapshots") + ", " + _plan_sql("snapshots", str(NOW_MS)) + " SELECT count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, count(*) AS total FROM planned"),
    "tier_lookup": (tier_lookup, f"WITH a AS (SELECT i * {HOUR} AS age_ms FROM range(500) t(i)) SELECT age_ms, CAST({_TIER.format(now='age_ms', t='0')} AS INTEGER) AS tier FROM a"),
    "tier_order_check": (tier_order_check, "SELECT CAST(i AS INTEGER) AS tier, true AS ok FROM range(4) t(i)"),
    "steady_state_occupancy": (
        steady_state_occupancy,
        "WITH h AS (SELECT i AS days, i * 24 AS x FROM range(400) t(i)), g AS (SELECT * FROM (VALUES (0, 24, 3), (24, 96, 24), (96, 384, 96), (384, 1000000000, 384)) v(a, b, w)) SELECT days, CAST(sum(CASE WHEN least(b, x) > a THEN ceil((least(b, x) - a) / w) ELSE 0 END) AS BIGINT) AS snapshots FROM h, g GROUP BY days",
    ),
    "retention_cells": (retention_cells, with_sql("events_") + f" SELECT event_id, CAST(floor(at_ms / {3 * HOUR}) AS BIGINT) AS cell FROM events_"),
    "refcounts": (refcounts, with_sql("refs", "chunk_index") + " SELECT i.chunk_id, i.chunk_len, count(r.chunk_id) AS refcount FROM chunk_index i LEFT JOIN refs r USING (chunk_id) GROUP BY i.chunk_id, i.chunk_len"),
    "zero_ref_chunks": (zero_ref_chunks, _STORE + " SELECT chunk_id, chunk_len FROM chunk_index WHERE chunk_id NOT IN (SELECT chunk_id FROM kept_refs)"),
    "store_status": (
        store_status,
        with_sql("snapshots", "refs", "chunk_index")
        + " SELECT (SELECT count(*) FROM snapshots) AS snapshots, (SELECT max(time_ms) FROM snapshots) AS newest_ms, count(*) AS chunks_unique, CAST(sum(chunk_len) AS BIGINT) AS store_bytes, count(*) FILTER (n = 0) AS chunks_zero_ref, CAST(sum(n) AS BIGINT) AS refs_total FROM (SELECT i.chunk_id, any_value(i.chunk_len) AS chunk_len, count(r.chunk_id) AS n FROM chunk_index i LEFT JOIN refs r USING (chunk_id) GROUP BY i.chunk_id)",
    ),
    "snapshots_by_owner": (snapshots_by_owner, with_sql("snapshots") + " SELECT CASE WHEN owner % 10 = 0 THEN '' ELSE CAST(owner AS VARCHAR) END AS owner, count(*) AS snapshots FROM snapshots GROUP BY 1"),
    "owner_map": (owner_map, with_sql("snapshots") + " SELECT string_agg(o || '=' || CAST(n AS VARCHAR), ',' ORDER BY o) AS owners FROM (SELECT CAST(owner % 12 AS VARCHAR) AS o, count(*) AS n FROM snapshots GROUP BY 1)"),
    "fk_violations": (fk_violations, with_sql("refs", "chunk_index") + " SELECT snapshot_id, seq, chunk_id FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_index WHERE chunk_id % 13 <> 0)"),
    "prune_then_refcount": (
        prune_then_refcount,
        _STORE + " SELECT refcount, count(*) AS chunks, CAST(sum(chunk_len) AS BIGINT) AS bytes FROM (SELECT i.chunk_id, any_value(i.chunk_len) AS chunk_len, count(r.chunk_id) AS refcount FROM chunk_index i LEFT JOIN kept_refs r USING (chunk_id) GROUP BY i.chunk_id) GROUP BY refcount",
    ),
    "gc_reconcile": (gc_reconcile, _GC + " SELECT chunk_id, chunk_len, action, marked_ms FROM step"),
    "gc_outcome": (gc_outcome, _GC + " SELECT count(*) FILTER (action = 'sweep') AS reclaimed, CAST(coalesce(sum(chunk_len) FILTER (action = 'sweep'), 0) AS BIGINT) AS reclaimed_bytes, count(*) FILTER (action IN ('wait', 'mark')) AS pending FROM step"),
    "gc_runs": (
        gc_runs,
        with_sql("chunk_index").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, seen AS (SELECT chunk_id, r, r * 1800000 AS run_ms, (chunk_id % 5 + r) % 4 <> 0 AND chunk_id % 7 <> 0 AS zero FROM chunk_index, range(8) t(r)),
f AS (SELECT chunk_id, CAST(-1 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS marked, CAST(NULL AS BIGINT) AS swept FROM chunk_index
UNION ALL SELECT f.chunk_id, s.r,
CASE WHEN f.swept IS NULL AND s.zero AND f.marked IS NOT NULL AND s.run_ms - f.marked >= 3600000 THEN NULL WHEN f.swept IS NOT NULL OR NOT s.zero THEN NULL ELSE coalesce(f.marked, s.run_ms) END,
CASE WHEN f.swept IS NULL AND s.zero AND f.marked IS NOT NULL AND s.run_ms - f.marked >= 3600000 THEN s.run_ms ELSE f.swept END
FROM f JOIN seen s ON s.chunk_id = f.chunk_id AND s.r = f.r + 1)
SELECT chunk_id, marked AS marked_ms, swept AS swept_ms FROM f WHERE r = 7""",
    ),
    "last_events": (last_events, with_sql("events_") + " SELECT kind, at_ms, detail FROM (SELECT event_type AS kind, at_ms, CAST(event_id AS VARCHAR) AS detail, row_number() OVER (PARTITION BY event_type ORDER BY at_ms DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events_) WHERE k = 1"),
    "latest_n_snapshots": (latest_n_snapshots, with_sql("snapshots") + " SELECT snapshot_id, time_ms FROM snapshots ORDER BY time_ms DESC, snapshot_id DESC LIMIT 5"),
    "snapshot_listing": (snapshot_listing, with_sql("snapshots") + " SELECT snapshot_id, time_ms, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d %H:%M:%S UTC') AS created FROM snapshots"),
    "has_chunks": (has_chunks, with_sql("refs", "chunk_index") + " SELECT snapshot_id * 10 + seq AS pos, chunk_id FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_index WHERE chunk_id % 4 <> 1)"),
    "put_chunks": (put_chunks, with_sql("refs", "chunk_index") + " SELECT DISTINCT chunk_id, chunk_id % 50 AS chunk_len FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_index WHERE chunk_id % 4 <> 1)"),
    "upload_ack": (upload_ack, with_sql("refs", "chunk_index") + " SELECT count(DISTINCT chunk_id) FILTER (NOT held) AS stored, count(*) - count(DISTINCT chunk_id) FILTER (NOT held) AS already_present FROM (SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM chunk_index WHERE chunk_id % 4 <> 1) AS held FROM refs)"),
    "put_snapshots": (
        put_snapshots,
        with_sql("snapshots", "refs", "chunk_index") + " SELECT snapshot_id, CASE WHEN snapshot_id % 5 = 0 THEN 'duplicate_snapshot' WHEN snapshot_id IN (SELECT snapshot_id FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_index WHERE chunk_id % 29 <> 0)) THEN 'unknown_ref' ELSE 'ok' END AS outcome FROM snapshots",
    ),
    "delete_snapshot": (delete_snapshot, with_sql("refs", "chunk_index") + " SELECT CAST(sum(n) AS BIGINT) AS refs, count(*) FILTER (n = 0) AS zero, max(n) AS most FROM (SELECT i.chunk_id, count(r.chunk_id) AS n FROM chunk_index i LEFT JOIN (SELECT * FROM refs WHERE snapshot_id % 17 <> 0) r USING (chunk_id) GROUP BY i.chunk_id)"),
    "delete_chunk": (
        delete_chunk,
        _STORE + ", c AS (SELECT i.chunk_id, count(r.chunk_id) AS n FROM chunk_index i LEFT JOIN kept_refs r USING (chunk_id) GROUP BY i.chunk_id) SELECT w.chunk_id, CASE WHEN c.n IS NULL THEN 'missing_chunk' WHEN c.n > 0 THEN 'still_referenced' ELSE 'deleted' END AS outcome FROM (SELECT chunk_id * 2 AS chunk_id FROM chunk_index) w LEFT JOIN c USING (chunk_id)",
    ),
    "chunk_lookup": (chunk_lookup, with_sql("chunk_index") + " SELECT chunk_id, chunk_len FROM chunk_index WHERE chunk_id = 42"),
    "client_auth_status": (
        client_auth_status,
        with_sql("clients") + " SELECT s.fingerprint, c.name, CASE WHEN c.revoked IS NULL THEN 'unknown' WHEN c.revoked THEN 'revoked' ELSE 'active' END AS status FROM (SELECT sha256(CAST(i * 3 AS VARCHAR)) AS fingerprint FROM range(2000) t(i)) s LEFT JOIN clients c USING (fingerprint)",
    ),
    "client_repeated_names": (client_repeated_names, with_sql("clients") + " SELECT name, count(*) AS n FROM clients WHERE NOT revoked GROUP BY name HAVING count(*) > 1"),
    "client_revoke": (client_revoke, with_sql("clients") + " SELECT count(*) FILTER (name = 'client-10' AND NOT revoked) AS changed FROM clients"),
    "client_names": (
        client_names,
        r"SELECT c_custkey, octet_length(encode(n)) BETWEEN 1 AND 64 AND NOT regexp_matches(n, '[\x00-\x1f\x7f]') AS usable FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_name || chr(9) WHEN c_custkey % 13 = 0 THEN repeat(c_name, 9) ELSE c_name END AS n FROM customer)",
    ),
    "token_spend": (
        token_spend,
        "SELECT event_id AS pos, event_id % 97 AS token, event_id % 97 < 80 AND event_id = min(event_id) OVER (PARTITION BY event_id % 97) AS spent FROM events",
    ),
    "phase_detection": (phase_detection, with_sql("snapshots") + " SELECT i AS store, CASE WHEN i IN (SELECT snapshot_id % 3 FROM snapshots) THEN 'incremental' ELSE 'initial' END AS phase FROM range(5) t(i)"),
    "progress_throttle": (
        progress_throttle,
        "WITH RECURSIVE t AS (SELECT user_id AS run, (epoch_us(ts) // 1000) AS at_ms FROM events), f AS (SELECT run, min(at_ms) AS at_ms FROM t GROUP BY run UNION ALL SELECT f.run, (SELECT min(t.at_ms) FROM t WHERE t.run = f.run AND t.at_ms - f.at_ms >= 21600000) FROM f WHERE f.at_ms IS NOT NULL), g AS (SELECT run, at_ms FROM f WHERE at_ms IS NOT NULL UNION SELECT run, max(at_ms) FROM t GROUP BY run) SELECT run, count(*) AS shown, max(at_ms) AS last_ms FROM g GROUP BY run",
    ),
    "running_progress": (
        running_progress,
        with_sql("files") + " SELECT path, count(*) OVER w AS files_done, CAST(sum(size) OVER w AS BIGINT) AS bytes_done FROM (SELECT split_part(path, '/', 1) AS root, path, size FROM files) WINDOW w AS (PARTITION BY root ORDER BY path ROWS UNBOUNDED PRECEDING)",
    ),
}
