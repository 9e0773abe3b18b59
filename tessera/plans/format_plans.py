"""Queries over scalar formats, codecs, policies and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formats as f
from tessera.operators import policy as P
from tessera.plans import views as V
from tessera.plans.views import with_sql
from tessera.sources import sinks

INF = float("inf")
_TEXTS = ["256K", "1m", "4096", "", "12Q", " 8k ", "0", "M", "1 K", "-5", "+5", "9223372036854775807", "9223372036854775807K"]
_SPANS = ["3h", "10m", "45s", "90", "", "h", "1d", " 2h ", "7 m", "3H", "4M", "5S", "+6"]
_SIZES = [0, 1, 1023, 1024, 1536, 4096, 262144, 1048576, 1048577, 3221225472, 5 * 2**40, 123456789]
_PATHS = ["a/b.txt", "", "/abs", "../x", "a/../b", "a//b", "a/./b", "ok", "c:/x", "a\\b", "é/ü.md", ".hidden/x", "..a/b"]
_NAMES = ["a.DB", "x/y.sqlite3", "r.docx", "s.zip", "p.PDF", "i.jpeg", "n.tiff", "c.rs", "d.d/none", "e.", ".bashrc", "t.tar.gz", "q.html", "noext"]


def _values(s, kind: str, values: list):
    return s.createDataFrame([(v,) for v in values], f"x {kind}")


def _list(values: list) -> str:
    text = ", ".join("('" + v.replace("'", "''") + "')" if isinstance(v, str) else f"({v})" for v in values)
    return f"(VALUES {text}) t(x)"


def size_parse(s, d):
    return _values(s, "string", _TEXTS).select("x", f.parse_size(F.col("x")).alias("bytes"))


def duration_parse(s, d):
    return _values(s, "string", _SPANS).select("x", f.parse_duration(F.col("x")).alias("seconds"))


def size_label(s, d):
    return V.chunk_index(s, d).select("chunk_id", f.size_label(F.col("chunk_len") * 512).alias("label"))


def human_bytes(s, d):
    return _values(s, "long", _SIZES).select("x", f.human_bytes(F.col("x")).alias("text"))


def utc_format(s, d):
    return V.snapshots(s, d).select("snapshot_id", f.utc_text(F.col("time_ms")).alias("created"))


def civil_dates(s, d):
    return s.range(0, 20000, 37).select(F.col("id").alias("days"), f.civil_date(F.col("id")).cast("string").alias("date"))


def id_times(s, d):
    """The time in the first 48 bits of ids made from it."""
    made = V.snapshots(s, d).select("snapshot_id", "time_ms", F.unhex(F.concat(F.lpad(F.hex("time_ms"), 12, "0"), F.lit("00112233445566778899"))).alias("id"))
    return made.select("snapshot_id", f.id_time_ms(F.col("id")).alias("time_ms"), f.id_ok(F.col("id"), 16).alias("ok"))


def content_ids(s, d):
    return V.files(s, d).select("path", f.content_id(F.col("text")).alias("chunk_id"))


def hmac_ids(s, d):
    return V.table(s, d, "documents").select("doc_id", f.keyed_id(F.coalesce("text", F.lit("")), b"k" * 32).alias("chunk_id"))


def id_parse(s, d):
    texts = V.chunk_index(s, d).select("chunk_id", F.sha2(F.col("chunk_id").cast("string"), 256).alias("h"))
    odd = F.when(F.col("chunk_id") % 5 == 0, F.upper("h")).when(F.col("chunk_id") % 5 == 1, F.substring("h", 1, 63)).when(F.col("chunk_id") % 5 == 2, F.concat(F.lit("g"), F.substring("h", 2, 63))).otherwise(F.col("h"))
    return texts.select("chunk_id", f.id_hex(f.parse_id(odd)).alias("parsed"))


def pem_parse(s, d):
    """Names sent as text in lines, of which some are damaged, read back as bytes."""
    rows = V.table(s, d, "customer").select("c_custkey", f.pem_text(F.repeat("c_name", 5).cast("binary"), "NAME").alias("pem"))
    k = F.col("c_custkey")
    sent = F.when(k % 7 == 0, F.regexp_replace("pem", "NAME-----\n.", "NAME-----\n*")).when(k % 7 == 1, F.translate("pem", "=", "")).when(k % 7 == 2, F.regexp_replace("pem", "\n", "\r\n")).otherwise(F.col("pem"))
    return rows.select("c_custkey", f.id_hex(f.parse_pem(sent)).alias("bytes"))


def path_safety(s, d):
    return _values(s, "string", _PATHS).select("x", f.safe_path(F.col("x")).alias("safe"))


def file_classes(s, d):
    return _values(s, "string", _NAMES).select("x", f.file_class(F.col("x")).alias("class"))


def file_class_totals(s, d):
    return V.files(s, d).groupBy(f.file_class(F.col("path")).alias("class")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def frames(s, d):
    made = V.files(s, d).select("path", f.frame(F.when(F.col("size") % 3 == 0, 0).when(F.col("size") % 3 == 1, 1).otherwise(7), F.col("text").cast("binary")).alias("framed"))
    return made.select("path", f.frame_codec(F.col("framed")).alias("codec"), f.codec_label(f.frame_codec(F.col("framed"))).alias("label"), F.octet_length(f.frame_payload(F.col("framed"))).cast("long").alias("payload"))


def sealed_round_trip(s, d):
    """Sealed and opened texts, and what opening under another id gives."""
    key, nonce = F.unhex(F.lit("00" * 32)), F.unhex(F.lit("01" * 12))
    rows = V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("bound"))
    sealed = rows.withColumn("sealed", f.seal(F.col("text").cast("binary"), key, nonce, F.col("bound").cast("binary")))
    return sealed.select("doc_id", (f.unseal(F.col("sealed"), key, F.col("bound").cast("binary")).cast("string") == F.col("text")).alias("same"), f.unseal(F.col("sealed"), key, F.lit(b"other")).isNull().alias("refused"), (F.octet_length("sealed") - F.octet_length("text")).cast("long").alias("overhead"))


def policy_dimension(s, d):
    return P.dimension(s).select("ord", "policy", "use_probe", "escalate", F.when(F.col("keep_threshold") == INF, -1.0).otherwise(F.col("keep_threshold")).alias("keep_threshold"))


def _choices(s, d):
    """Codec choices with given lengths, in which SQL can follow: raw_len, stored_len by a rule."""
    rows = V.files(s, d).select("path", F.md5("text").alias("chunk_id"), F.col("size").alias("raw_len"))
    packed = F.floor(F.col("raw_len") * (F.conv(F.substring("chunk_id", 1, 6), 16, 10).cast("long") % 120) / 100).cast("long")
    rows = rows.withColumn("packed", packed).withColumn("codec", F.when((F.col("raw_len") > 0) & (F.col("packed") <= F.col("raw_len") * P.KEEP), 1).otherwise(0))
    # the higher level is tried on what packs well, and saves a byte on some of that
    rows = rows.withColumn("attempted", (F.col("codec") == 1) & (F.col("raw_len") >= P.ESCALATE * F.col("packed"))).withColumn("escalated", F.col("attempted") & (F.col("packed") % 3 > 0))
    return rows.withColumn("stored_len", F.when(F.col("codec") == 0, F.col("raw_len")).otherwise(F.col("packed") - F.col("escalated").cast("long")))


def policy_counters(s, d):
    return P.stored(P.counters(_choices(s, d)))


def class_rollup(s, d):
    return P.class_rollup(_choices(s, d))


def codec_policy(s, d):
    """Every policy over the unique documents' bytes, counted."""
    chunks = V.files(s, d).select(F.sha2("text", 256).alias("chunk_id"), F.col("text").cast("binary").alias("data")).dropDuplicates(["chunk_id"])
    return P.stored(P.counters(P.chosen(chunks).drop("wall"), "ord", "policy")).orderBy("ord")


def policy_report(s, d):
    """Rates, times and steady state of each policy, with the increment of an assumed churn."""
    rates = dict(read_rate=500.0, cdc_rate=900.0, hash_rate=1200.0, seal_rate=800.0)
    rows = codec_policy(s, d)
    for k, v in rates.items():
        rows = rows.withColumn(k, F.lit(v))
    rows = rows.withColumn("codec_rate", F.when(F.col("policy") == "raw-only", INF).otherwise(300.0))
    rows = P.policy_rows(rows, 8, 1_000_000).withColumn("wall", F.when(F.col("policy") == "raw-only", 0.0).otherwise(F.col("bytes_in") / f.MIB / 300.0))
    none = {f"delta_{k}": F.lit(None).cast("double") for k in ("in", "stored", "wall")}
    rows = rows.withColumns({"total_bytes": F.col("bytes_in"), "whole_in": F.col("bytes_in"), "whole_stored": F.col("stored_bytes"), "whole_wall": F.col("wall"), "churn_pct": F.lit(2.0), **none})
    return P.incremental(rows, 8).select("ord", "policy", "rate", "cpu_seconds", "steady_bytes", "churn_source", "incremental_bytes", "incremental_stored", "incremental_seconds")


def recommended_policy(s, d):
    rows = s.createDataFrame([(0, "raw-only", 10.0, 900), (1, "zstd3-always", 30.0, 500), (2, "zstd3", 28.0, 510), (3, "probe", 25.0, 505), (4, "escalate", 60.0, 400), (5, "late", 42.0, 500)], "ord int, policy string, cpu_seconds double, steady_bytes long")
    return P.recommend_policy(rows)


def harmonic_rate(s, d):
    rows = V.chunk_index(s, d).select("chunk_id", (F.col("chunk_len") * 1.0).alias("a"), F.when(F.col("chunk_id") % 3 == 0, INF).otherwise(F.col("chunk_id") * 2.0).alias("b"), F.when(F.col("chunk_id") % 4 == 0, 0.0).otherwise(7.0).alias("c"))
    return rows.select("chunk_id", F.round(f.harmonic_rate(F.col("a"), F.col("b"), F.col("c")), 6).alias("rate"))


def bandwidth_projection(s, d):
    rows = V.chunk_index(s, d).select("chunk_id", (F.col("chunk_len") / 10.0).alias("cpu_seconds"), (F.col("chunk_len") * 10_000_000).alias("stored_bytes"))
    return P.bandwidth(rows).select("chunk_id", F.col("mbit").cast("long").alias("mbit"), F.round("seconds", 6).alias("seconds"))


def transfer_rates(s, d):
    """Rates of measured transfers, the seconds they give back, and the seconds of ten MiB at a fixed rate or none."""
    rows = V.chunk_index(s, d).select("chunk_id", F.when(F.col("chunk_id") % 5 == 0, 0).otherwise(F.col("chunk_len") * f.MIB).alias("size"), (F.col("chunk_id") % 4).cast("double").alias("t"))
    rate = f.mib_per_second(F.col("size"), F.col("t"))
    fixed = f.seconds_for(F.lit(10 * f.MIB), F.when(F.col("t") == 1, -2.0).otherwise(2.0))
    return rows.select("chunk_id", F.when(rate == INF, -1.0).otherwise(F.round(rate, 6)).alias("rate"), F.round(f.seconds_for(F.col("size"), rate), 6).alias("seconds"), fixed.alias("at_rate"))


def progress_eta(s, d):
    rows = V.chunk_index(s, d).select("chunk_id", (F.col("chunk_id") % 60).alias("done"), F.lit(50).alias("total"), F.when(F.col("chunk_id") % 7 == 0, 0.0).otherwise(12.0).alias("elapsed"))
    eta = f.eta_seconds(F.col("done"), F.col("total"), F.col("elapsed"))
    return rows.select("chunk_id", F.round(eta, 6).alias("eta"), f.eta_suffix(eta).alias("suffix"), F.round(f.progress_rate(F.col("done") * f.MIB, F.col("elapsed")), 6).alias("mib_per_sec"))


def assumed_churn_scale(s, d):
    counted = V.chunk_index(s, d).select("chunk_id", F.col("chunk_len").alias("n"))
    return P.scaled(counted.select("n", F.col("chunk_id").cast("string").alias("id")), F.lit(0.15)).select("id", "n")


def incremental_cost(s, d):
    k = F.col("chunk_id")
    size = F.col("chunk_len") * f.MIB
    rows = V.chunk_index(s, d).select(
        "chunk_id", size.alias("total_bytes"), F.when(k % 3 == 0, F.col("chunk_len") * 1000).alias("delta_in"), F.when(k % 3 == 0, F.col("chunk_len") * 400).alias("delta_stored"), F.when(k % 3 == 0, F.col("chunk_len") * 1000 / f.MIB / 200.0).alias("delta_wall"),
        size.alias("whole_in"), F.floor(size / 2).alias("whole_stored"), (F.col("chunk_len") / 200.0).alias("whole_wall"), F.when(k % 2 == 0, (k % 300 - 50) * 1.0).alias("churn_pct"),
        F.lit(100.0).alias("read_rate"), F.lit(200.0).alias("cdc_rate"), F.lit(INF).alias("hash_rate"), F.lit(100.0).alias("seal_rate"),
    )
    return P.incremental(rows).select("chunk_id", "churn_source", "incremental_bytes", "incremental_stored", F.round("scan_seconds", 6).alias("scan_seconds"), F.round("incremental_seconds", 6).alias("incremental_seconds"))


def schedule_delays(s, d):
    draws = V.chunk_index(s, d).select("chunk_id", ((F.col("chunk_id") % 101) / 100.0).alias("draw"))
    return draws.select("chunk_id", F.round(f.next_delay(F.lit(10800.0), 0.1, F.col("draw")), 6).alias("delay"), F.round(f.next_delay(F.lit(10800.0), 0.0, F.col("draw")), 6).alias("exact"))


def prune_modes(s, d):
    return _values(s, "int", [0, 1, 2]).select("x", f.prune_mode(F.col("x")).alias("mode"))


def status_codes(s, d):
    return _values(s, "string", ["missing_chunk", "duplicate_snapshot", "unknown_ref", "hash_mismatch", "bad_id", "else"]).select("x", f.status_code(F.col("x")).alias("code"))


def caveat_text(s, d):
    return _values(s, "boolean", [True, False]).select("x", f.caveat(F.col("x")).alias("text"))


def json_report(s, d):
    rows = V.chunk_index(s, d).groupBy((F.col("chunk_len") % 4).alias("k")).agg(F.count("*").alias("n"))
    return sinks.json_report(rows, tool="sizing", snapshots=36)


def _label(x: str) -> str:
    return f"CASE WHEN {x} > 0 AND {x} % 1048576 = 0 THEN CAST({x} // 1048576 AS VARCHAR) || 'M' WHEN {x} > 0 AND {x} % 1024 = 0 THEN CAST({x} // 1024 AS VARCHAR) || 'K' ELSE CAST({x} AS VARCHAR) || 'B' END"


_CLASS = "CASE " + " ".join(f"WHEN {{e}} IN ({', '.join(repr(x) for x in exts)}) THEN '{name}'" for name, exts in f.CLASSES.items()) + " ELSE 'other' END"
_EXT = r"lower(regexp_extract({p}, '\.([^./]+)$', 1))"
_CHOICES = (
    with_sql("files")
    + """, k AS (SELECT path, md5(text) AS chunk_id, size AS raw_len, CAST(floor(size * (CAST('0x' || substr(md5(text), 1, 6) AS INTEGER) % 120) / 100) AS BIGINT) AS packed FROM files),
c AS (SELECT *, raw_len > 0 AND packed <= raw_len * 0.95::DOUBLE AS z FROM k), h AS (SELECT *, CASE WHEN z THEN packed - CAST(e AS INTEGER) ELSE raw_len END AS stored_len FROM (SELECT *, z AND raw_len >= 2 * packed AS t, z AND raw_len >= 2 * packed AND packed % 3 > 0 AS e FROM c))"""
)

QUERIES = {
    "size_parse": (size_parse, rf"SELECT x, TRY_CAST(CAST(regexp_extract(trim(x), '^\+?([0-9]+)', 1) AS HUGEINT) * CASE upper(right(trim(x), 1)) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 ELSE 1 END AS BIGINT) AS bytes FROM (SELECT x FROM {_list(_TEXTS)} WHERE regexp_matches(trim(x), '^\+?[0-9]+[kKmM]?$')) UNION ALL SELECT x, NULL FROM {_list(_TEXTS)} WHERE NOT regexp_matches(trim(x), '^\+?[0-9]+[kKmM]?$')"),
    "duration_parse": (duration_parse, rf"SELECT x, CASE WHEN regexp_matches(trim(x), '^\+?[0-9]+[hHmMsS]?$') THEN CAST(regexp_extract(trim(x), '^\+?([0-9]+)', 1) AS BIGINT) * CASE lower(right(trim(x), 1)) WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END END AS seconds FROM {_list(_SPANS)}"),
    "size_label": (size_label, with_sql("chunk_index") + f" SELECT chunk_id, {_label('(chunk_len * 512)')} AS label FROM chunk_index"),
    "human_bytes": (human_bytes, f"SELECT CAST(x AS BIGINT) AS x, CASE WHEN x < 1024 THEN CAST(x AS VARCHAR) || ' B' WHEN x < 1048576 THEN printf('%.2f KiB', x / 1024) WHEN x < 1073741824 THEN printf('%.2f MiB', x / 1048576) WHEN x < 1099511627776 THEN printf('%.2f GiB', x / 1073741824) ELSE printf('%.2f TiB', x / 1099511627776) END AS text FROM {_list(_SIZES)}"),
    "utc_format": (utc_format, with_sql("snapshots") + " SELECT snapshot_id, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d %H:%M:%S UTC') AS created FROM snapshots"),
    "civil_dates": (civil_dates, "SELECT i AS days, CAST(DATE '1970-01-01' + CAST(i AS INTEGER) AS VARCHAR) AS date FROM range(0, 20000, 37) t(i)"),
    "id_times": (id_times, with_sql("snapshots") + " SELECT snapshot_id, time_ms, true AS ok FROM snapshots"),
    "content_ids": (content_ids, with_sql("files") + " SELECT path, sha256(text) AS chunk_id FROM files"),
    "hmac_ids": (
        hmac_ids,
        "SELECT doc_id, sha256(unhex('" + bytes(b ^ 0x5C for b in (b"k" * 32).ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in (b"k" * 32).ljust(64, b"\0")).hex() + "') || encode(coalesce(text, ''))))) AS chunk_id FROM documents",
    ),
    "id_parse": (id_parse, with_sql("chunk_index") + " SELECT chunk_id, CASE WHEN chunk_id % 5 NOT IN (1, 2) THEN sha256(CAST(chunk_id AS VARCHAR)) END AS parsed FROM chunk_index"),
    "pem_parse": (pem_parse, "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(hex(encode(repeat(c_name, 5)))) END AS bytes FROM customer"),
    "path_safety": (path_safety, rf"SELECT x, x <> '' AND NOT regexp_matches(x, '[\x00\\]') AND NOT regexp_matches(x, '^[A-Za-z]:') AND NOT list_has_any(string_split(x, '/'), ['', '.', '..']) AS safe FROM {_list(_PATHS)}"),
    "file_classes": (file_classes, f"SELECT x, {_CLASS.format(e=_EXT.format(p='x'))} AS class FROM {_list(_NAMES)}"),
    "file_class_totals": (file_class_totals, with_sql("files") + f" SELECT {_CLASS.format(e=_EXT.format(p='path'))} AS class, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1"),
    "frames": (frames, with_sql("files") + " SELECT path, CAST(CASE size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INTEGER) AS codec, CASE size % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'zstd' END AS label, size AS payload FROM files"),
    "sealed_round_trip": (sealed_round_trip, "SELECT doc_id, true AS same, true AS refused, CAST(28 AS BIGINT) AS overhead FROM documents"),
    "policy_dimension": (policy_dimension, "SELECT CAST(o AS INTEGER) AS ord, p AS policy, u AS use_probe, e AS escalate, CAST(k AS DOUBLE) AS keep_threshold FROM (VALUES (0, 'raw-only', false, false, 0.0), (1, 'zstd3-always', false, false, -1.0), (2, 'zstd3', false, false, 0.95), (3, 'probe', true, false, 0.95), (4, 'escalate', true, true, 0.95)) t(o, p, u, e, k)"),
    "policy_counters": (
        policy_counters,
        _CHOICES + ", t AS (SELECT count(*) FILTER (NOT z) AS raw_chunks, count(*) FILTER (z AND NOT e) AS zstd_chunks, count(*) FILTER (e) AS escalated_chunks, count(*) FILTER (t) AS attempts, CAST(sum(raw_len) AS BIGINT) AS bytes_in, CAST(sum(stored_len) AS BIGINT) AS bytes_out, count(*) AS n FROM h) SELECT raw_chunks, zstd_chunks, escalated_chunks, attempts, bytes_in, bytes_out, greatest(bytes_in - bytes_out, 0) AS bytes_saved, bytes_out + n AS framed_bytes, bytes_out + 41 * n AS stored_bytes, round(bytes_in / (bytes_out + 41 * n), 6) AS ratio FROM t",
    ),
    "class_rollup": (
        class_rollup,
        _CHOICES
        + f""", o AS (SELECT chunk_id, min(path) AS path, min(raw_len) AS a, min(stored_len) AS b FROM h GROUP BY chunk_id),
g AS (SELECT {_CLASS.format(e=_EXT.format(p='path'))} AS class, CAST(sum(a) AS BIGINT) AS bytes_in, CAST(sum(b) AS BIGINT) AS bytes_out FROM o GROUP BY 1)
SELECT CAST(list_position({f.CLASS_ORDER!r}, class) AS INTEGER) AS ord, class, bytes_in, bytes_out, CASE WHEN sum(bytes_in - bytes_out) OVER () > 0 THEN round((bytes_in - bytes_out) / sum(bytes_in - bytes_out) OVER (), 6) ELSE 0.0 END AS share_of_savings FROM g""",
    ),
    "codec_policy": (codec_policy, None),
    "policy_report": (policy_report, None),
    "recommended_policy": (recommended_policy, "SELECT 'zstd3-always' AS policy, CAST(500 AS BIGINT) AS steady_bytes"),
    "harmonic_rate": (harmonic_rate, with_sql("chunk_index") + " SELECT chunk_id, round(CASE WHEN s > 0 THEN 1 / s ELSE CAST('Infinity' AS DOUBLE) END, 6) AS rate FROM (SELECT chunk_id, CASE WHEN chunk_len > 0 THEN 1.0::DOUBLE / chunk_len ELSE 0 END + CASE WHEN chunk_id % 3 = 0 THEN 0 ELSE 1.0::DOUBLE / (chunk_id * 2) END + CASE WHEN chunk_id % 4 = 0 THEN 0 ELSE 1.0::DOUBLE / 7 END AS s FROM chunk_index)"),
    "bandwidth_projection": (bandwidth_projection, with_sql("chunk_index") + " SELECT chunk_id, CAST(m AS BIGINT) AS mbit, round(greatest(chunk_len / 10.0::DOUBLE, chunk_len * 10000000 / 1048576::DOUBLE / (m / 8::DOUBLE)), 6) AS seconds FROM chunk_index, (VALUES (50), (200), (1000)) v(m)"),
    "transfer_rates": (transfer_rates, with_sql("chunk_index") + " SELECT chunk_id, CASE WHEN t = 0 OR n = 0 THEN -1.0 ELSE round(n / t, 6) END AS rate, CASE WHEN t = 0 OR n = 0 THEN 0.0 ELSE round(n / (n / t), 6) END AS seconds, CASE WHEN t = 1 THEN 0.0 ELSE 5.0 END AS at_rate FROM (SELECT chunk_id, CASE WHEN chunk_id % 5 = 0 THEN 0.0 ELSE CAST(chunk_len AS DOUBLE) END AS n, CAST(chunk_id % 4 AS DOUBLE) AS t FROM chunk_index)"),
    "progress_eta": (progress_eta, with_sql("chunk_index") + " SELECT chunk_id, round(e, 6) AS eta, CASE WHEN e IS NULL THEN '' ELSE ', ETA ~' || CAST(CAST(round(e) AS BIGINT) AS VARCHAR) || 's' END AS suffix, CASE WHEN t > 0 THEN round(n / t, 6) ELSE 0.0 END AS mib_per_sec FROM (SELECT chunk_id, n, t, CASE WHEN n > 0 AND n < 50 AND t > 0 THEN (50 - n) / (n / t) END AS e FROM (SELECT chunk_id, chunk_id % 60 AS n, CASE WHEN chunk_id % 7 = 0 THEN 0.0::DOUBLE ELSE 12.0::DOUBLE END AS t FROM chunk_index))"),
    "assumed_churn_scale": (assumed_churn_scale, with_sql("chunk_index") + " SELECT CAST(chunk_id AS VARCHAR) AS id, CAST(round(chunk_len * 0.15::DOUBLE) AS BIGINT) AS n FROM chunk_index"),
    "incremental_cost": (
        incremental_cost,
        with_sql("chunk_index")
        + """, r AS (SELECT chunk_id AS k, chunk_len AS n, chunk_id % 3 = 0 AS m, CASE WHEN chunk_id % 2 = 0 THEN CAST(chunk_id % 300 - 50 AS DOUBLE) END AS churn FROM chunk_index),
c AS (SELECT *, CASE WHEN churn IS NULL THEN NULL ELSE greatest(0.0, least(100.0, churn)) / 100 END AS share FROM r),
b AS (SELECT *, CASE WHEN m THEN CAST(n * 1000 AS DOUBLE) ELSE round(n * 1048576 * share) END AS bytes, CASE WHEN m THEN CAST(n * 400 AS DOUBLE) ELSE round(n * 524288 * share) END AS kept FROM c)
SELECT k AS chunk_id, CASE WHEN m THEN 'measured' WHEN churn IS NOT NULL THEN 'assumed' END AS churn_source, CAST(bytes AS BIGINT) AS incremental_bytes, CAST(kept AS BIGINT) AS incremental_stored,
round(CASE WHEN m OR churn IS NOT NULL THEN n / 100.0::DOUBLE END, 6) AS scan_seconds,
round(CASE WHEN m OR churn IS NOT NULL THEN n / 100.0::DOUBLE + CASE WHEN bytes > 0 THEN bytes / 1048576 / (1 / (1 / 200.0::DOUBLE + 1 / 200.0::DOUBLE + 1 / 100.0::DOUBLE)) ELSE 0 END END, 6) AS incremental_seconds FROM b""",
    ),
    "schedule_delays": (schedule_delays, with_sql("chunk_index") + " SELECT chunk_id, round(10800.0::DOUBLE * (1 + 0.1::DOUBLE * (2 * (chunk_id % 101 / 100.0::DOUBLE) - 1)), 6) AS delay, CAST(10800.0 AS DOUBLE) AS exact FROM chunk_index"),
    "prune_modes": (prune_modes, "SELECT CAST(x AS INTEGER) AS x, CASE x WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' END AS mode FROM (VALUES (0), (1), (2)) t(x)"),
    "status_codes": (status_codes, "SELECT * FROM (VALUES ('missing_chunk', 'NOT_FOUND'), ('duplicate_snapshot', 'ALREADY_EXISTS'), ('unknown_ref', 'FAILED_PRECONDITION'), ('hash_mismatch', 'DATA_LOSS'), ('bad_id', 'INVALID_ARGUMENT'), ('else', 'INTERNAL')) t(x, code)"),
    "caveat_text": (caveat_text, "SELECT * FROM (VALUES (true, 'overlap and increments are measured against the baseline'), (false, 'no baseline: increments are assumed, not measured')) t(x, text)"),
    "json_report": (json_report, with_sql("chunk_index") + """ SELECT '{"tool":"sizing","snapshots":36,"rows":[' || string_agg('{"k":' || CAST(k AS VARCHAR) || ',"n":' || CAST(n AS VARCHAR) || '}', ',' ORDER BY k) || ']}' AS json FROM (SELECT chunk_len % 4 AS k, count(*) AS n FROM chunk_index GROUP BY 1)"""),
}
