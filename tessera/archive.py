"""A store of snapshots in Parquet: backup, list, restore, prune, collect and status.

Each table is a folder of generations; the newest complete one is read. Appends go into it, rewrites make the next.
All paths are Spark's, so the store may be in any file system that Spark reaches. One writer at a time is assumed.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, dedup, policy, restore, retention
from tessera.operators import store as S
from tessera.sources.tree import dealt, opener, read_tree

TABLES = {
    "chunks": "chunk_id string, chunk_len long, data binary",
    "snapshots": "snapshot_id string, time_ms long, owner string",
    "files": "snapshot_id string, path string, size long, mtime_secs long, mtime_nanos int, mode long",
    "refs": "snapshot_id string, path string, seq int, chunk_id string",
    "marks": "chunk_id string, marked_ms long",
    "events": "kind string, at_ms long, detail string",
}


def new_id(now_ms: int) -> str:
    """An id in hex whose first 48 bits are the time, so that ids sort by it."""
    return f"{now_ms:012x}{secrets.token_hex(10)}"


@dataclass
class Archive:
    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _generation(self, name: str) -> int:
        fs, path = self._fs()
        folder = path(f"{self.path}/{name}")
        if not fs.exists(folder):
            return -1
        whole = [int(x.getPath().getName()[4:]) for x in fs.listStatus(folder) if fs.exists(path(f"{x.getPath()}/_SUCCESS"))]
        return max(whole, default=-1)

    def table(self, name: str) -> DataFrame:
        n = self._generation(name)
        if n < 0:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/gen-{n:08d}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.table(name).columns).write.mode("append").parquet(f"{self.path}/{name}/gen-{max(0, self._generation(name)):08d}")

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{name}/gen-{self._generation(name) + 1:08d}")

    def _event(self, kind: str, at_ms: int, detail: str) -> None:
        self._append("events", self.spark.createDataFrame([(kind, at_ms, detail)], TABLES["events"]))

    def _sweep(self) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/_staging"), True)

    def backup(self, roots: list[str], now_ms: int, owner: str | None = None, target: int = 1 << 20, codec: str = "escalate", auto_prune: bool = False) -> dict:
        """Takes a snapshot of some folders; returns its id and the ledger.

        Chunks are cut once into a staging table; those that the store lacks are encoded once each and appended, then
        the references, and the snapshot's own row last, so a backup that fails leaves no snapshot.
        """
        snapshot_id = new_id(now_ms)
        held = self.table("snapshots")
        incremental = not held.isEmpty()  # of any owner: their chunks serve all
        chosen = next(p for p in policy.POLICIES if p.name == codec)
        self._sweep()  # what a backup that failed has left
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        files = read_tree(self.spark, *roots, content=False)
        chunking.streamed(dealt(files), opener(tuple(roots)), [target], with_data=True).write.parquet(staging)
        chunks = self.spark.read.parquet(staging)
        ledger = dedup.ledger(files, chunks, self.table("chunks")).first().asDict()

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(data=[policy.encode(bytes(x), chosen, incremental) for x in b["data"]])

        fresh = chunks.select("chunk_id", F.col("len").alias("chunk_len"), "data").join(self.table("chunks").select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
        self._append("chunks", fresh.mapInPandas(encode, TABLES["chunks"]))
        own = self.spark.createDataFrame([(snapshot_id, now_ms, owner)], TABLES["snapshots"])
        own, refs = S.put_snapshot(held, self.table("chunks"), own, chunks.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "seq", "chunk_id"))
        self._append("refs", refs)
        self._append("files", files.withColumn("snapshot_id", F.lit(snapshot_id)))
        self._append("snapshots", own)
        self._sweep()
        self._event("backup", now_ms, snapshot_id)
        if auto_prune:
            self.prune(now_ms, mode="auto")
        return {"snapshot_id": snapshot_id, "phase": "incremental" if incremental else "initial", **ledger}

    def list(self) -> DataFrame:
        return S.listed(self.table("snapshots"))

    def outcomes(self, snapshot_id: str) -> DataFrame:
        """For each file of a snapshot whether its chunks are there, whole and those asked for."""
        refs = self.table("refs").filter(F.col("snapshot_id") == snapshot_id)
        got = refs.join(self._decoded(refs), "chunk_id", "left")
        got = got.select("path", "seq", F.col("chunk_id").alias("asked_id"), F.when(F.col("data").isNotNull(), F.col("chunk_id")).alias("sent_id"), F.sha2("data", 256).alias("real_id"), F.octet_length("data").alias("len"))
        return restore.checked(self.table("files").filter(F.col("snapshot_id") == snapshot_id), got)

    def _decoded(self, refs: DataFrame) -> DataFrame:
        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(data=[policy.decode(bytes(x)) for x in b["data"]])

        wanted = self.table("chunks").select("chunk_id", "data").join(refs.select("chunk_id"), "chunk_id", "left_semi")
        return wanted.mapInPandas(decode, "chunk_id string, data binary")

    def restore(self, snapshot_id: str, target: str) -> dict:
        """Writes a snapshot's files below an empty folder of this machine; nothing is written if anything is wrong."""
        files = self.table("files").filter(F.col("snapshot_id") == snapshot_id)
        if self.table("snapshots").filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise ValueError("missing_snapshot")
        bad = self.outcomes(snapshot_id).filter("outcome <> 'ok'").first()
        if bad:
            raise ValueError(f"{bad.path}: {bad.outcome}")
        refs = self.table("refs").filter(F.col("snapshot_id") == snapshot_id)
        parts = refs.select("path", "seq", "chunk_id").join(self._decoded(refs), "chunk_id").select("path", "seq", "data")
        n = restore.write_files(files.select("path", "mtime_secs", "mtime_nanos", "mode"), parts, target)
        return {"files": n, "bytes": files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]}

    def delete(self, *snapshot_ids: str) -> None:
        gone = self.spark.createDataFrame([(x,) for x in snapshot_ids], "snapshot_id string")
        for name in ("snapshots", "refs", "files"):
            self._rewrite(name, self.table(name).join(gone, "snapshot_id", "left_anti"))

    def prune(self, now_ms: int, grid: tuple[retention.Tier, ...] = retention.GRID, mode: str = "manual") -> dict:
        """Keeps what the grid keeps over the whole store."""
        before = self.table("snapshots").count()
        kept = retention.survivors(self.table("snapshots"), F.lit(now_ms), grid).select("snapshot_id")
        for name in ("refs", "files", "snapshots"):
            self._rewrite(name, self.table(name).join(kept, "snapshot_id", "left_semi"))
        after = self.table("snapshots").count()
        self._event("prune", now_ms, mode)
        return {"kept": after, "dropped": before - after}

    def gc(self, now_ms: int, grace_ms: int = 3_600_000) -> dict:
        """One collection; logged even if it reclaims nothing."""
        step = S.gc_step(self.table("chunks").select("chunk_id", "chunk_len"), self.table("refs"), self.table("marks"), now_ms, grace_ms)
        outcome = S.gc_outcome(step).first().asDict()
        swept = step.filter("action = 'sweep'").select("chunk_id")
        marks = step.filter("action IN ('wait', 'mark')").select("chunk_id", "marked_ms")
        if outcome["reclaimed"]:
            self._rewrite("chunks", self.table("chunks").join(swept, "chunk_id", "left_anti"))
        self._rewrite("marks", marks)
        self._event("gc", now_ms, str(outcome["reclaimed"]))
        return outcome

    def status(self) -> dict:
        index = self.table("chunks").select("chunk_id", "chunk_len")
        row = S.status(self.table("snapshots"), self.table("refs"), index).first().asDict()
        owners = {r.owner: r.snapshots for r in S.by_owner(self.table("snapshots")).collect()}  # one row an owner
        last = {r.kind: {"at_ms": r.at_ms, "detail": r.detail} for r in S.last_events(self.table("events")).collect()}
        return row | {"snapshots_by_owner": owners, "last": last}
