"""The store's relations: reference counts, status, integrity, inserts, deletes and garbage collection.

Reference counts are never kept: they are counted from the references of live snapshots. chunk_index has chunk_id and
chunk_len; refs has snapshot_id, seq and chunk_id, each occurrence a row; snapshots has snapshot_id, time_ms, owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import retention


def refcounts(chunk_index: DataFrame, refs: DataFrame) -> DataFrame:
    """Every chunk with its occurrences over live snapshots."""
    counts = refs.groupBy("chunk_id").agg(F.count("*").alias("refcount"))
    return chunk_index.join(counts, "chunk_id", "left").select("chunk_id", "chunk_len", F.coalesce("refcount", F.lit(0)).cast("long").alias("refcount"))


def zero_ref(chunk_index: DataFrame, refs: DataFrame) -> DataFrame:
    return chunk_index.join(refs, "chunk_id", "left_anti")


def unknown_refs(refs: DataFrame, chunk_index: DataFrame) -> DataFrame:
    """References to chunks that the index lacks."""
    return refs.join(chunk_index, "chunk_id", "left_anti")


def missing(asked: DataFrame, chunk_index: DataFrame) -> DataFrame:
    """Asked ids that the index lacks, in the order asked, repeats kept. asked: pos, chunk_id."""
    return asked.join(chunk_index, "chunk_id", "left_anti").select("pos", "chunk_id").orderBy("pos")


def lookup(chunk_index: DataFrame, chunk_id) -> DataFrame:
    return chunk_index.filter(F.col("chunk_id") == F.lit(chunk_id))


def put_chunks(chunk_index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows to append: incoming chunks not yet there, once each. incoming: chunk_id, chunk_len."""
    return incoming.groupBy("chunk_id").agg(F.min("chunk_len").alias("chunk_len")).join(chunk_index, "chunk_id", "left_anti")


def acknowledged(chunk_index: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many uploads were stored, and how many were already there (repeats count as there)."""
    held = chunk_index.select("chunk_id", F.lit(True).alias("held"))
    each = incoming.groupBy("chunk_id").agg(F.count("*").alias("n")).join(held, "chunk_id", "left")
    stored = F.coalesce(F.sum(F.when(F.col("held").isNull(), 1).otherwise(0)), F.lit(0)).cast("long")
    return each.agg(stored.alias("stored"), (F.coalesce(F.sum("n"), F.lit(0)) - stored).cast("long").alias("already_present"))


def put_outcomes(snapshots: DataFrame, chunk_index: DataFrame, incoming: DataFrame, refs: DataFrame) -> DataFrame:
    """What becomes of each incoming snapshot: refused if its id is taken or one of its references is unknown, else ok."""
    taken = snapshots.select("snapshot_id", F.lit(True).alias("taken"))
    bad = unknown_refs(refs, chunk_index).groupBy("snapshot_id").agg(F.lit(True).alias("bad"))
    outcome = F.when(F.col("taken"), "duplicate_snapshot").when(F.col("bad"), "unknown_ref").otherwise("ok")
    return incoming.join(taken, "snapshot_id", "left").join(bad, "snapshot_id", "left").select("snapshot_id", outcome.alias("outcome"))


def put_snapshot(snapshots: DataFrame, chunk_index: DataFrame, snapshot: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to append for one snapshot; an error if its id is taken or a reference is unknown."""
    refused = put_outcomes(snapshots, chunk_index, snapshot, refs).filter("outcome <> 'ok'").first()
    if refused:
        raise ValueError(refused.outcome)
    return snapshot, refs


def delete_snapshots(snapshots: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots and references without some snapshots. gone: snapshot_id."""
    return snapshots.join(gone, "snapshot_id", "left_anti"), refs.join(gone, "snapshot_id", "left_anti")


def deletable(chunk_index: DataFrame, refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted chunk whether it may go: known and not referenced. wanted: chunk_id."""
    counts = refcounts(chunk_index, refs).select("chunk_id", "refcount")
    outcome = F.when(F.col("refcount").isNull(), "missing_chunk").when(F.col("refcount") > 0, "still_referenced").otherwise("deleted")
    return wanted.join(counts, "chunk_id", "left").select("chunk_id", outcome.alias("outcome"))


def by_owner(snapshots: DataFrame) -> DataFrame:
    """Snapshots of each owner in the owners' order; those without owner count under the empty name."""
    return snapshots.groupBy(F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner")).agg(F.count("*").alias("snapshots")).orderBy("owner")


def status(snapshots: DataFrame, refs: DataFrame, chunk_index: DataFrame) -> DataFrame:
    """One row: snapshots, chunks, bytes, and the chunks that nothing references."""
    chunks = refcounts(chunk_index, refs).agg(
        F.count("*").alias("chunks_unique"), F.coalesce(F.sum("chunk_len"), F.lit(0)).cast("long").alias("store_bytes"), F.count_if(F.col("refcount") == 0).alias("chunks_zero_ref"), F.coalesce(F.sum("refcount"), F.lit(0)).cast("long").alias("refs_total")
    )
    taken = snapshots.agg(F.count("*").alias("snapshots"), F.max("time_ms").alias("newest_ms"))
    return taken.join(chunks, F.lit(True))  # two tables of one row


def latest(snapshots: DataFrame, n: int) -> DataFrame:
    """The newest n snapshots, oldest first."""
    return snapshots.orderBy(F.desc("time_ms"), F.desc("snapshot_id")).limit(n).orderBy("time_ms", "snapshot_id")


def listed(snapshots: DataFrame) -> DataFrame:
    """Snapshots by time and id with their time as text."""
    return snapshots.select("snapshot_id", "time_ms", formats.utc_text(F.col("time_ms")).alias("created")).orderBy("time_ms", "snapshot_id")


def prune(snapshots: DataFrame, refs: DataFrame, now_ms: Column, policy=retention.GRID) -> tuple[DataFrame, DataFrame]:
    """Snapshots and references that stay after pruning the whole store."""
    kept = retention.survivors(snapshots, now_ms, policy).select("snapshot_id")
    return snapshots.join(kept, "snapshot_id", "left_semi"), refs.join(kept, "snapshot_id", "left_semi")


def gc_step(chunk_index: DataFrame, refs: DataFrame, marks: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """What one collection does to each marked or unreferenced chunk: chunk_id, chunk_len, action, marked_ms.

    An unreferenced chunk is marked when first seen and swept by a later run once the grace is over; a mark on a chunk
    that is referenced again, or gone, is cleared. marks: chunk_id, marked_ms.
    """
    zero = zero_ref(chunk_index, refs).select("chunk_id", "chunk_len", F.lit(True).alias("zero"))
    both = zero.join(marks, "chunk_id", "full_outer")
    old = F.lit(now_ms) - F.col("marked_ms") >= grace_ms
    action = F.when(F.col("zero").isNull(), "clear").when(F.col("marked_ms").isNull(), "mark").when(old, "sweep").otherwise("wait")
    return both.select("chunk_id", "chunk_len", action.alias("action"), F.coalesce("marked_ms", F.lit(now_ms)).alias("marked_ms"))


def gc_outcome(step: DataFrame) -> DataFrame:
    """One row: reclaimed chunks and bytes, and chunks that wait."""
    swept = F.col("action") == "sweep"
    return step.agg(F.count_if(swept).alias("reclaimed"), F.coalesce(F.sum(F.when(swept, F.col("chunk_len"))), F.lit(0)).cast("long").alias("reclaimed_bytes"), F.count_if(F.col("action").isin("wait", "mark")).alias("pending"))


def gc_apply(chunk_index: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and the marks after a collection."""
    swept = step.filter("action = 'sweep'").select("chunk_id")
    return chunk_index.join(swept, "chunk_id", "left_anti"), step.filter("action IN ('wait', 'mark')").select("chunk_id", "marked_ms")


def gc_history(states: DataFrame, grace_ms: int) -> DataFrame:
    """What several runs make of each chunk. states: chunk_id, run_ms, zero (whether the run saw it unreferenced).

    Returns chunk_id, marked_ms (the standing mark, if any) and swept_ms (the run that swept it, if one did). Each
    chunk's runs are folded in order; there are as many as runs.
    """
    runs = F.array_sort(F.collect_list(F.struct("run_ms", "zero")))
    none = F.lit(None).cast("long")

    def after(state: Column, run: Column) -> Column:
        marked = F.when(state["swept"].isNotNull() | ~run["zero"], none).otherwise(F.coalesce(state["marked"], run["run_ms"]))
        due = state["swept"].isNull() & run["zero"] & state["marked"].isNotNull() & (run["run_ms"] - state["marked"] >= grace_ms)
        return F.struct(F.when(due, none).otherwise(marked).alias("marked"), F.when(due, run["run_ms"]).otherwise(state["swept"]).alias("swept"))

    fold = F.aggregate("runs", F.struct(none.alias("marked"), none.alias("swept")), after)
    return states.groupBy("chunk_id").agg(runs.alias("runs")).select("chunk_id", fold.alias("end")).select("chunk_id", F.col("end.marked").alias("marked_ms"), F.col("end.swept").alias("swept_ms"))


def last_events(events: DataFrame) -> DataFrame:
    """The newest event of each kind. events: kind, at_ms, detail."""
    return events.groupBy("kind").agg(F.max("at_ms").alias("at_ms"), F.max_by("detail", F.struct("at_ms", "detail")).alias("detail"))


def authenticated(seen: DataFrame, clients: DataFrame) -> DataFrame:
    """The standing of each presented fingerprint: active, revoked or unknown, and its name. seen: fingerprint."""
    state = F.when(F.col("revoked").isNull(), "unknown").when(F.col("revoked"), "revoked").otherwise("active")
    return seen.join(clients, "fingerprint", "left").select("fingerprint", "name", state.alias("status"))


def repeated_names(clients: DataFrame) -> DataFrame:
    """Names that more than one active client has."""
    return clients.filter(~F.col("revoked")).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def revoke(clients: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """The clients after a revocation, and the aggregate that counts the rows it changes."""
    hit = (F.col("name") == name) & ~F.col("revoked")
    return clients.withColumn("revoked", F.col("revoked") | (F.col("name") == name)), F.count_if(hit)


def spend(tokens: DataFrame, shown: DataFrame) -> DataFrame:
    """For each shown token whether it stands and so is spent now; the first showing wins. shown: pos, token."""
    first = shown.groupBy("token").agg(F.min("pos").alias("pos"))
    good = first.join(tokens, "token", "left_semi").select("pos", F.lit(True).alias("good"))
    return shown.join(good, "pos", "left").select("pos", "token", F.coalesce("good", F.lit(False)).alias("spent"))


def verified(wanted: DataFrame, objects: DataFrame, strict: bool = False) -> DataFrame:
    """The outcome of reading each wanted chunk: ok, missing, length_mismatch or hash_mismatch; an error if strict and not ok.

    wanted: chunk_id (hex), chunk_len; objects: chunk_id, data.
    """
    outcome = (
        F.when(F.col("data").isNull(), "missing")
        .when(F.octet_length("data") != F.col("chunk_len"), "length_mismatch")
        .when(formats.content_id(F.col("data")) != F.col("chunk_id"), "hash_mismatch")
        .otherwise("ok")
    )
    rows = wanted.join(objects, "chunk_id", "left").select("chunk_id", outcome.alias("outcome"))
    if strict:
        rows = rows.withColumn("outcome", F.when(F.col("outcome") == "ok", F.col("outcome")).otherwise(F.raise_error(F.concat_ws(": ", "chunk_id", "outcome")).cast("string")))
    return rows
