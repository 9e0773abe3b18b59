import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, dedup, policy, restore, sizing

RNG = random.Random(5)
DATA = RNG.randbytes(300_000)


def test_chunks_tile_and_keep_bounds():
    config = chunking.Config.of(4096)
    chunks = chunking.chunk_bytes(DATA, config)
    assert [c[0] for c in chunks] == [sum(x[1] for x in chunks[:i]) for i in range(len(chunks))]
    assert sum(c[1] for c in chunks) == len(DATA)
    assert all(config.min <= c[1] <= config.max for c in chunks[:-1])
    assert 1500 < len(DATA) / len(chunks) < 10_000
    assert chunks == chunking.chunk_bytes(DATA, config)


def test_an_inserted_byte_keeps_most_chunks():
    data = random.Random(1).randbytes(3_000_000)
    config = chunking.Config.of(16384)
    before = {c[2] for c in chunking.chunk_bytes(data, config)}
    after = {c[2] for c in chunking.chunk_bytes(b"x" + data, config)}
    assert len(before & after) > 0.9 * len(before)


def test_small_and_empty():
    config = chunking.Config.of(4096)
    assert chunking.chunk_bytes(b"", config) == []
    assert [c[1] for c in chunking.chunk_bytes(b"abc", config)] == [3]
    zeros = chunking.chunk_bytes(bytes(100_000), config)
    assert len({c[2] for c in zeros[:-1]}) == 1
    assert chunking.chunk_bytes(b"abc", config, b"key")[0][2] != chunking.chunk_bytes(b"abc", config)[0][2]


def _by_definition(data, config):
    """The chunker one byte at a time."""
    bits, ends, start = max(1, config.target.bit_length() - 1), [], 0
    hashes = [int(h) for h in chunking.rolling(chunking.np.frombuffer(data, chunking.np.uint8))]
    while start < len(data):
        end = min(start + config.max, len(data))
        for place in range(start + config.min, end):
            zeros = bits + 1 if place <= start + config.target else bits - 1
            if hashes[place - 1] >> (64 - zeros) == 0:
                end = place
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("block", [1, 63, 1000, 10**6])
def test_streamed_cuts_are_those_of_the_whole(block):
    data = DATA[:20_000] if block == 1 else DATA
    configs = [chunking.Config.of(t) for t in (256, 1024, 4096)]
    stream = chunking.Stream(configs)
    got = [[] for _ in configs]
    most = 0
    for start in [*range(0, len(data), block), None]:
        for k, spans in enumerate(stream.close() if start is None else stream.feed(data[start : start + block])):
            got[k] += [(a, b, stream.bytes(a, b)) for a, b in spans]
        stream.trim()
        most = max(most, len(stream.held))
    for config, spans in zip(configs, got, strict=True):
        assert [b for _, b, _ in spans] == chunking.cuts(data, [config])[0] == _by_definition(data, config)
        assert b"".join(x for _, _, x in spans) == data
    assert most <= 16384 + block


def test_files_are_chunked_as_they_are_read(spark, tmp_path):
    from tessera.sources.tree import dealt, opener, read_tree

    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / "a").write_bytes(DATA)
    (root / "sub/b").write_bytes(DATA[7:])
    (root / "none").write_bytes(b"")
    rows = lambda df: sorted((r.path, r.target_size, r.seq, r.offset, r.len, r.chunk_id, bytes(r.data)) for r in df.collect())
    files = read_tree(spark, str(root), content=False)
    whole = rows(chunking.chunked(read_tree(spark, str(root)), [512, 4096], with_data=True))
    assert rows(chunking.streamed(dealt(files), opener((str(root),)), [512, 4096], with_data=True)) == whole


def test_segments_do_not_move_cuts(monkeypatch):
    config = chunking.Config.of(1024)
    whole = chunking.cuts(DATA, [config])
    monkeypatch.setattr(chunking, "_SEGMENT", 7777)
    assert chunking.cuts(DATA, [config]) == whole


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=5000))
def test_any_bytes(data):
    config = chunking.Config.of(256)
    assert b"".join(data[a : a + n] for a, n, _ in chunking.chunk_bytes(data, config)) == data


@pytest.mark.parametrize("size", [16, 255, 32 << 20])
def test_sizes_out_of_range(size):
    with pytest.raises(ValueError):
        chunking.Config.of(size)


def test_fan_out_is_each_alone(spark):
    files = spark.createDataFrame([("a", bytearray(DATA[:50_000])), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    got = chunking.chunked(files, [512, 2048], with_data=True).collect()
    for target in (512, 2048):
        want = chunking.chunk_bytes(DATA[:50_000], chunking.Config.of(target))
        mine = sorted((r.offset, r.len, r.chunk_id) for r in got if r.target_size == target)
        assert mine == want
    assert b"".join(bytes(r.data) for r in sorted(got, key=lambda r: r.seq) if r.target_size == 512) == DATA[:50_000]


def test_report_of_three_references(spark):
    files = spark.createDataFrame([("a/b.txt", 300), ("c.bin", 200)], "path string, size long")
    chunks = spark.createDataFrame([(1, "a/b.txt", "1", 100), (1, "a/b.txt", "2", 200), (1, "c.bin", "2", 200)], "target_size long, path string, chunk_id string, len long")
    r = sizing.report(files, chunks, 17).first()
    assert (r.total_chunks, r.unique_chunks, r.unique_bytes, r.p50, r.p95, r.index_bytes, r.manifest_bytes, r.bookkeeping_bytes) == (3, 2, 300, 200, 200, 96, 200, 96 + 17 * 200)


def test_report_of_nothing(spark):
    files = spark.createDataFrame([], "path string, size long")
    chunks = spark.createDataFrame([], "target_size long, path string, chunk_id string, len long")
    r = sizing.report(files, chunks, 36, sizes=[512]).first()
    assert (r.target_size, r.total_chunks, r.dedup_ratio, r.mean_len, r.p95, r.manifest_bytes, r.overlap_pct) == (512, 0, 1.0, 0.0, 0, 28, 0.0)


def test_percentiles_are_nearest_rank(spark):
    for n in (1, 2, 3, 19, 20, 21, 100, 101):
        rng = random.Random(n)
        lens = [rng.randint(1, 50) for _ in range(n)]
        chunks = spark.createDataFrame([(1, "p", str(x), x) for x in lens], "target_size long, path string, chunk_id string, len long")
        r = sizing.report(spark.createDataFrame([("p", 1)], "path string, size long"), chunks, 1).first()
        assert (r.p50, r.p95) == tuple(sorted(lens)[max(1, -(-n * p // 100)) - 1] for p in (50, 95))


def test_recommendation(spark):
    rows = lambda x: spark.createDataFrame(x, "target_size long, cost long")
    assert sizing.recommend(rows([(1024, 150), (512, 140), (256, 140)])).first()[0] == 256
    assert sizing.recommend(rows([(1, 1)]).limit(0)).count() == 0
    assert sizing.candidates([512, 256, 512]) == [512, 256]


def test_overlap_of_nothing(spark):
    none = spark.createDataFrame([], "path string, seq long, chunk_id string, len long")
    assert tuple(dedup.overlap(none, none).first()) == (0, 0, 0.0)


def test_throttle_and_batches(spark):
    ticks = spark.createDataFrame([(1, t) for t in (0, 100, 149, 150, 299, 301, 310)], "run int, at_ms long")
    assert sorted(r.at_ms for r in dedup.throttled(ticks).collect()) == [0, 150, 301, 310]
    rows = spark.createDataFrame([("r", i, 10) for i in range(7)], "root string, seq long, len long")
    assert [r.batch for r in dedup.batches(rows, 3, 10**6).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert [r.batch for r in dedup.batches(rows, 99, 20).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_codec_choice():
    text, noise = b"the quick brown fox jumps over the lazy dog. " * 200, DATA[:9000]
    by = {p.name: p for p in policy.POLICIES}
    assert policy.choose(text, by["zstd3"], False)[0] == policy.ZSTD
    assert policy.choose(noise, by["zstd3"], False)[:3] == (policy.RAW, 9000, False)
    assert policy.choose(noise, by["probe"], False)[:3] == (policy.RAW, 9000, False)
    assert policy.choose(noise, by["zstd3-always"], False)[0] == policy.ZSTD
    assert policy.choose(text, by["raw-only"], False)[0] == policy.RAW
    assert policy.choose(text, by["escalate"], True)[3] and not policy.choose(text, by["escalate"], False)[3]
    for p in policy.POLICIES:
        for data in (text, noise, b""):
            assert policy.decode(policy.encode(data, p)) == data
    with pytest.raises(ValueError):
        policy.decode(b"\x02abc")


def test_stored_is_what_frames_and_seals_take(spark):
    chunks = spark.createDataFrame([("a", bytearray(b"ab" * 5000)), ("b", bytearray(DATA[:5000]))], "chunk_id string, data binary")
    for r in policy.stored(policy.counters(policy.chosen(chunks), "ord", "policy")).collect():
        p = policy.POLICIES[r.ord]
        assert r.stored_bytes == sum(len(policy.encode(d, p)) + 40 for d in (b"ab" * 5000, DATA[:5000]))


def test_manifest_round_trip_and_every_cut():
    row = {"snapshot_id": bytes(range(16)), "created_at": -7, "files": [{"path": "ü/a", "size": 0, "mtime_secs": -5, "mtime_nanos": 9, "mode": 2**31 + 5, "chunks": []}, {"path": "b", "size": 3, "mtime_secs": 1, "mtime_nanos": 0, "mode": 420, "chunks": [b"x" * 32, b"y" * 32]}]}
    raw = restore.encode_manifest(row)
    assert len(raw) == 28 + 32 * 2 + len("ü/a".encode()) + 1 + 64
    assert restore.decode_manifest(raw) == row
    for n in range(len(raw)):
        with pytest.raises(ValueError):
            restore.decode_manifest(raw[:n])
    with pytest.raises(ValueError):
        restore.decode_manifest(raw + b"\0")


def test_manifests_as_rows(spark):
    row = {"snapshot_id": bytes(16), "created_at": 5, "files": [{"path": "p", "size": 1, "mtime_secs": 0, "mtime_nanos": 0, "mode": 1, "chunks": [b"a" * 32, b"a" * 32]}]}
    blobs = spark.createDataFrame([(bytearray(restore.encode_manifest(row)),)], "blob binary")
    refs = restore.exploded(restore.decoded(blobs)).collect()
    assert [(r.path, r.chunk_no, bytes(r.chunk_id)) for r in refs] == [("p", 0, b"a" * 32), ("p", 1, b"a" * 32)]


def test_tree_source_and_restore(spark, tmp_path):
    from tessera.sources.tree import read_tree, totals

    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / ".hid").mkdir()
    for name, content in ((".hid/c", b"c"), ("_b.txt", b"bb"), ("a.txt", b"a"), ("sub/empty.bin", b"")):
        (root / name).write_bytes(content)
    os.symlink(root / "a.txt", root / "link")
    os.utime(root / "a.txt", ns=(0, -1_500_000_000))
    rows = {r.path: r for r in read_tree(spark, str(root)).collect()}
    assert sorted(rows) == [".hid/c", "_b.txt", "a.txt", "sub/empty.bin"]
    assert (rows["a.txt"].mtime_secs, rows["a.txt"].mtime_nanos) == (-2, 500_000_000)
    assert tuple(totals(read_tree(spark, str(root), content=False)).first()) == (4, 4)
    from tessera.sources import tree

    before, tree.DIRECTORIES = tree.DIRECTORIES, 1  # the driver looks at the root only, tasks at the rest
    try:
        assert sorted(r.path for r in read_tree(spark, str(root), content=False).collect()) == sorted(rows)
    finally:
        tree.DIRECTORIES = before
    other = tmp_path / "more"
    other.mkdir()
    (other / "x").write_bytes(b"x")
    both = [r.path for r in read_tree(spark, str(root), str(other)).collect()]
    assert "more/x" in both and "data/a.txt" in both
    target = tmp_path / "out"
    parts = chunking.chunked(read_tree(spark, str(root)), [256], with_data=True).select("path", "seq", "data")
    assert restore.write_files(read_tree(spark, str(root), content=False), parts, str(target)) == 4
    assert os.stat(target / "a.txt").st_mtime_ns == -1_500_000_000
    assert (target / "sub/empty.bin").read_bytes() == b"" and (target / "_b.txt").read_bytes() == b"bb"
    with pytest.raises(FileExistsError):
        restore.write_files(read_tree(spark, str(root), content=False), parts, str(target))


def test_two_orders(spark):
    files = spark.createDataFrame([("a/x",), ("a.txt",)], "path string")
    got = {r.path: (r.by_path, r.by_directory) for r in dedup.places(files.withColumn("root", F.lit("r"))).collect()}
    assert got == {"a.txt": (1, 2), "a/x": (2, 1)}


def test_streamed_uploads_are_kept_once(spark, tmp_path):
    from tessera.streaming import upkeep

    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "chunk_id string, chunk_len long")
    frame.write.parquet(source)
    for _ in range(2):
        upkeep.upload(spark.readStream.schema(frame.schema).parquet(source), store, str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([("b", 2), ("c", 3)], frame.schema).write.mode("append").parquet(source)
    assert sorted(r.chunk_id for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


def test_schedule(spark):
    from tessera.streaming import upkeep

    draws = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 0.0)], "n int, draw double")
    many = upkeep.run_times(0, 10, 0.0, spark.range(1, 3001).select(F.col("id").alias("n"), F.lit(0.5).alias("draw")))
    assert many.agg(F.max("run_ms"), F.count("*")).first() == (2999 * 10_000, 3000)
    assert [r.run_ms for r in upkeep.run_times(1000, 10, 0.1, draws).orderBy("n").collect()] == [1000, 11000, 22000]


def test_collecting_stream(spark, tmp_path):
    from tessera.streaming import upkeep

    source = str(tmp_path / "seen")
    rows = [(1, 0, True), (1, 3599, True), (2, 0, True), (2, 10, False)]
    spark.createDataFrame(rows, "chunk_id long, run_ms long, zero boolean").write.parquet(source)
    stream = spark.readStream.schema("chunk_id long, run_ms long, zero boolean").parquet(source)
    try:
        q = upkeep.collect(stream, 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    except Exception as e:
        if "protobuf" in str(e).lower():
            pytest.skip("stateful Python processors need protobuf")
        raise
    got = sorted((r.chunk_id, r.run_ms, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "mark"), (1, 3599, "wait"), (2, 0, "mark"), (2, 10, "clear")]
