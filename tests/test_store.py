import pytest
from pyspark.sql import functions as F

from tessera.operators import retention, store

H = retention.HOUR


def fixture(spark):
    snaps = spark.createDataFrame([(1, 10, "laptop-a"), (2, 20, "laptop-a"), (3, 30, None)], "snapshot_id long, time_ms long, owner string")
    refs = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (2, 1, "b"), (3, 0, "b")], "snapshot_id long, seq int, chunk_id string")
    index = spark.createDataFrame([("a", 100), ("b", 200)], "chunk_id string, chunk_len long")
    return snaps, refs, index


def test_owners_and_deletes(spark):
    snaps, refs, index = fixture(spark)
    assert [tuple(r) for r in store.by_owner(snaps).collect()] == [("", 1), ("laptop-a", 2)]
    gone = spark.createDataFrame([(1,), (2,)], "snapshot_id long")
    left, less = store.delete_snapshots(snaps, refs, gone)
    assert left.count() == 1
    assert [r.chunk_id for r in store.zero_ref(index, less).collect()] == ["a"]
    assert dict(tuple(r) for r in store.deletable(index, less, spark.createDataFrame([("a",), ("b",), ("x",)], "chunk_id string")).collect()) == {"a": "deleted", "b": "still_referenced", "x": "missing_chunk"}


def test_unknown_references_refuse_the_snapshot(spark):
    snaps, refs, index = fixture(spark)
    new = spark.createDataFrame([(4, 40, "x")], snaps.schema)
    with pytest.raises(ValueError, match="unknown_ref"):
        store.put_snapshot(snaps, index, new, spark.createDataFrame([(4, 0, "zz")], refs.schema))
    with pytest.raises(ValueError, match="duplicate_snapshot"):
        store.put_snapshot(snaps, index, snaps.limit(1), refs)


def test_missing_keeps_order_and_repeats(spark):
    _, _, index = fixture(spark)
    asked = spark.createDataFrame([(0, "q"), (1, "a"), (2, "q"), (3, "c")], "pos int, chunk_id string")
    assert [tuple(r) for r in store.missing(asked, index).collect()] == [(0, "q"), (2, "q"), (3, "c")]


def test_prune_then_collect(spark):
    """481 snapshots, each with a chunk of its own and one shared; what pruning frees waits for the grace."""
    now = 480 * 3 * H
    snaps = spark.range(481).select(F.col("id").alias("snapshot_id"), (F.col("id") * 3 * H).alias("time_ms"), F.lit("o").alias("owner"))
    own = snaps.select("snapshot_id", F.lit(0).alias("seq"), F.col("snapshot_id").alias("chunk_id"))
    refs = own.unionByName(own.withColumn("seq", F.lit(1)).withColumn("chunk_id", F.lit(1000).cast("long")))
    index = refs.select("chunk_id").distinct().withColumn("chunk_len", F.lit(10).cast("long"))
    _, left = store.prune(snaps, refs, F.lit(now))
    none = spark.createDataFrame([], "chunk_id long, marked_ms long")
    first = store.gc_step(index, left, none, now, H)
    assert tuple(store.gc_outcome(first).first()) == (0, 0, 462)
    index2, marks = store.gc_apply(index, first)
    assert tuple(store.gc_outcome(store.gc_step(index2, left, marks, now + H - 1, H)).first()) == (0, 0, 462)
    second = store.gc_step(index2, left, marks, now + H, H)
    assert tuple(store.gc_outcome(second).first()) == (462, 4620, 0)
    assert store.gc_apply(index2, second)[0].count() == 20


def test_a_regained_reference_clears_the_mark(spark):
    states = spark.createDataFrame([(1, 0, True), (1, 10, False), (1, 20, True), (1, 29, True), (1, 30, True), (2, 0, True), (2, 9, True)], "chunk_id long, run_ms long, zero boolean")
    assert sorted(tuple(r) for r in store.gc_history(states, 10).collect()) == [(1, None, 30), (2, 0, None)]


def test_verified(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x).hexdigest()
    wanted = spark.createDataFrame([(h(b"ok"), 2), (h(b"gone"), 4), (h(b"short"), 5), (h(b"bad"), 3)], "chunk_id string, chunk_len long")
    held = spark.createDataFrame([(h(b"ok"), b"ok"), (h(b"short"), b"shor"), (h(b"bad"), b"baz")], "chunk_id string, data binary")
    got = dict(tuple(r) for r in store.verified(wanted, held).collect())
    assert got == {h(b"ok"): "ok", h(b"gone"): "missing", h(b"short"): "length_mismatch", h(b"bad"): "hash_mismatch"}


def test_tokens_are_spent_once(spark):
    tokens = spark.createDataFrame([("t",)], "token string")
    shown = spark.createDataFrame([(0, "t"), (1, "t"), (2, "u")], "pos int, token string")
    assert [r.spent for r in store.spend(tokens, shown).orderBy("pos").collect()] == [True, False, False]


def test_strict_reads_fail(spark):
    wanted = spark.createDataFrame([("aa", 1)], "chunk_id string, chunk_len long")
    none = spark.createDataFrame([], "chunk_id string, data binary")
    assert store.verified(wanted, none).first().outcome == "missing"
    with pytest.raises(Exception, match="aa: missing"):
        store.verified(wanted, none, strict=True).collect()
