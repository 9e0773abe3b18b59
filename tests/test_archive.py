import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.archive import Archive
from tessera.operators import retention
from tessera.plans import report
from tessera.sources import config

H = retention.HOUR


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    (root / "notes").mkdir(parents=True)
    (root / "big.bin").write_bytes(random.Random(1).randbytes(300_000))
    (root / "empty.bin").write_bytes(b"")
    (root / "notes/hello.txt").write_bytes(b"hello, world!\n")
    return root


def test_backup_edit_restore(spark, tree, tmp_path):
    store = Archive(spark, str(tmp_path / "store"))
    first = store.backup([str(tree)], 1_000_000, "laptop", 4096)
    assert (first["files"], first["source_bytes"], first["phase"]) == (3, 300_014, "initial")
    assert first["chunks_uploaded"] == first["chunks_unique"] and first["chunks_deduped"] == 0
    data = bytearray((tree / "big.bin").read_bytes())
    data[150_000:150_016] = b"x" * 16
    (tree / "big.bin").write_bytes(data)
    second = store.backup([str(tree)], 2_000_000, "laptop", 4096)
    assert second["chunks_uploaded"] <= 4 and second["upload_bytes"] < first["upload_bytes"] / 10
    assert second["phase"] == "incremental"
    third = store.backup([str(tree)], 3_000_000, "laptop", 4096)
    assert third["upload_bytes"] == 0
    assert [r.snapshot_id for r in store.list().collect()] == [first["snapshot_id"], second["snapshot_id"], third["snapshot_id"]]
    out = tmp_path / "out"
    assert store.restore(second["snapshot_id"], str(out)) == {"files": 3, "bytes": 300_014}
    assert (out / "big.bin").read_bytes() == bytes(data) and (out / "empty.bin").read_bytes() == b""
    store.delete(first["snapshot_id"])
    status = store.status()
    assert status["snapshots"] == 2 and status["snapshots_by_owner"] == {"laptop": 2} and 0 < status["chunks_zero_ref"] <= 4
    assert store.gc(10_000_000)["pending"] == status["chunks_zero_ref"]
    assert store.gc(10_000_000 + H)["reclaimed"] == status["chunks_zero_ref"]
    assert store.status()["chunks_zero_ref"] == 0
    assert store.status()["last"]["gc"]["at_ms"] == 10_000_000 + H
    assert {r.outcome for r in store.outcomes(third["snapshot_id"]).collect()} == {"ok"}


def test_prune_and_missing_chunks(spark, tree, tmp_path):
    store = Archive(spark, str(tmp_path / "store"))
    for k in range(3):
        last = store.backup([str(tree)], k * H, None, 65536)
    assert store.prune(2 * H) == {"kept": 1, "dropped": 2}
    store._rewrite("chunks", store.table("chunks").filter(F.col("chunk_len") < 1000))
    with pytest.raises(ValueError, match="missing_chunk"):
        store.restore(last["snapshot_id"], str(tmp_path / "out"))
    with pytest.raises(ValueError, match="missing_snapshot"):
        store.restore("00", str(tmp_path / "out"))


def test_report_over_folders(spark, tree, tmp_path):
    got = report.sizing_report(spark, str(tree), (4096,), baseline=str(tree), compression=True)
    row = got["candidates"][0]
    assert got["snapshots"] == 36 and got["recommended"] == 4096 and row["overlap_pct"] == 100.0
    assert row["total_bytes"] == got["dataset_bytes"] == 300_014
    assert [p["policy"] for p in got["policies"]][0] == "raw-only"
    assert json.loads(report.as_json(got))["snapshots"] == 36
    assert set(got["rates"]) == {"read", "cdc", "hash", "seal"} and all(r > 0 for r in got["rates"].values())
    assert {p["churn_source"] for p in got["policies"]} == {"measured"} and got["recommended_policy"]
    assert all(p["incremental_bytes"] == 0 and p["incremental_seconds"] == p["scan_seconds"] for p in got["policies"])
    assert sum(c["bytes_in"] for c in got["classes"]) == row["unique_bytes"]
    text = report.as_text(got)
    assert "4K" in text and "<- recommended" in text and "overlap %" in text and "raw-only" in text
    assumed = report.sizing_report(spark, str(tree), (4096,), compression=True, churn_pct=10.0)["policies"]
    assert all(p["churn_source"] == "assumed" and p["incremental_bytes"] == round(row["unique_bytes"] * 0.1) for p in assumed)
    unknown = report.sizing_report(spark, str(tree), (4096,), compression=True)["policies"]
    assert all(p["churn_source"] is None and p["incremental_bytes"] is None for p in unknown)
    with pytest.raises(ValueError):
        report.sizing_report(spark, str(tree), (4096, 8192), compression=True)


def test_commands(spark, tree, tmp_path, capsys):
    from tessera.__main__ import main

    store = str(tmp_path / "store")
    main(["--now-ms", "5", "backup", "--store", store, str(tree), "--target-size", "64K"])
    taken = json.loads(capsys.readouterr().out)
    main(["restore", "--store", store, taken["snapshot_id"], str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out)["files"] == 3
    main(["status", "--store", store])
    assert json.loads(capsys.readouterr().out)["snapshots"] == 1


def test_scheduled_backups(spark, tree, tmp_path, capsys):
    from tessera.__main__ import main

    store = str(tmp_path / "store")
    main(["run", "--store", store, str(tree), "--target-size", "64K", "--interval", "0.01", "--runs", "2"])
    ticks = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [t["error"] for t in ticks] == [None, None] and ticks[1]["result"]["upload_bytes"] == 0


def test_a_failing_run_does_not_end_the_loop():
    from tessera.streaming import upkeep

    at, slept, seen = [1000], [], []

    def sleep(seconds):
        slept.append(seconds)
        at[0] += int(seconds * 1000)

    def job(now):
        if len(seen) == 1:
            raise OSError("away")
        return now

    assert upkeep.run_loop(job, 10, 0.1, seen.append, runs=4, now_ms=lambda: at[0], sleep=sleep, draw=lambda: 1.0) == 4
    assert [t["started_ms"] for t in seen] == [1000, 12000, 23000, 34000] and [t["error"] for t in seen] == [None, "away", None, None]
    assert upkeep.prune_daily(lambda now: now, seen.append, sleep=lambda s: slept.append(s) or len(slept) > 4) == 1
    assert slept[-1] == 86_400.0
    with pytest.raises(ValueError):
        upkeep.run_loop(job, 0)


def test_prune_after_commits(spark, tmp_path):
    """Each batch of commits is followed by a prune; one that fails is reported and the stream goes on."""
    from tessera.streaming import upkeep

    source, calls = str(tmp_path / "in"), []
    for k in range(3):
        spark.createDataFrame([(k,)], "snapshot_id long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("snapshot_id long").option("maxFilesPerTrigger", 1).parquet(source)

    def prune(batch, number):
        calls.append((number, batch.count()))
        if number == 1:
            raise OSError("away")

    upkeep.pruned_after(stream, prune, str(tmp_path / "ck")).awaitTermination()
    assert calls == [(0, 1), (1, 1), (2, 1)]


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    assert config.load(str(path), config.CLIENT) == {}
    path.write_text('roots = ["a"]\njitter = 0.1\n')
    assert config.load(str(path), config.CLIENT)["jitter"] == 0.1
    path.write_text("what = 1\n")
    with pytest.raises(ValueError):
        config.load(str(path), config.CLIENT)
