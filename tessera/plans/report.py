"""The sizing report over folders, as one call, and as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import chunking, dedup, policy, rates, retention, sizing
from tessera.sources.tree import dealt, opener, read_tree

SIZES = (256 << 10, 512 << 10, 1 << 20, 2 << 20, 4 << 20)


def sizing_report(spark: SparkSession, root: str, sizes: tuple[int, ...] = SIZES, baseline: str | None = None, snapshots: int | None = None, compression: bool = False, churn_pct: float | None = None, threads: int | None = None, links: tuple[int, ...] = policy.BANDWIDTHS) -> dict:
    """Rows for each candidate size and the recommended one; for a single candidate with compression also measured rates and what each policy stores and costs."""
    sizes = sizing.candidates(list(sizes))
    if compression and len(sizes) != 1:
        raise ValueError("compression needs a single candidate size")
    if snapshots is None:
        snapshots = retention.occupancy(spark.range(365, 366).select(F.col("id").alias("days"))).first().snapshots
    files = read_tree(spark, root, content=False)
    chunks = chunking.streamed(dealt(files), opener((root,)), sizes, with_data=compression)
    before = chunking.streamed(dealt(read_tree(spark, baseline, content=False)), opener((baseline,)), sizes) if baseline else None
    rows = sizing.report(files, chunks, snapshots, before, sizes)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    out = {"root": root, "baseline": baseline, "files": n, "dataset_bytes": size, "snapshots": snapshots, "candidates": [r.asDict() for r in rows.orderBy("target_size").collect()]}
    best = sizing.recommend(rows.select("target_size", "cost")).first()
    out["recommended"] = best.target_size if best else None
    if compression:
        out |= _compression(files, chunks, before, root, sizes[0], out["candidates"][0], churn_pct, threads or spark.sparkContext.defaultParallelism, links)
    return out


def _compression(files: DataFrame, chunks: DataFrame, before: DataFrame | None, root: str, size: int, sized: dict, churn_pct: float | None, threads: int, links: tuple[int, ...]) -> dict:
    spark = files.sparkSession
    stages = {r.stage: r.rate for r in rates.measured(dealt(files), opener((root,)), chunking.Config.of(size)).collect()}
    unique = chunks.select("chunk_id", "data").dropDuplicates(["chunk_id"])
    whole = policy.stored(policy.counters(policy.chosen(unique), "ord", "policy"))
    if before is not None:
        new = policy.chosen(unique.join(dedup.delta(chunks, before).select("chunk_id"), "chunk_id", "left_semi"), incremental=True)
    else:  # the phase after the first, over everything, from which an assumed churn is scaled
        new = policy.chosen(unique, incremental=True)
    later = policy.stored(policy.counters(new, "ord", "policy")).collect()  # a row for each policy
    kind = "delta" if before is not None else "whole"
    names = [f"{kind}_{k}" for k in ("in", "stored", "wall")]
    costs = spark.createDataFrame([(r.ord, float(r.bytes_in), float(r.stored_bytes), r.wall) for r in later], "ord int, " + ", ".join(f"{x} double" for x in names))
    rows = whole.join(F.broadcast(costs), "ord", "left")
    if before is not None:  # nothing new is a delta of nothing
        rows = rows.fillna(0.0, names)
    other = "whole" if before is not None else "delta"
    rows = rows.withColumns({f"{other}_{k}": F.lit(None).cast("double") for k in ("in", "stored", "wall")})
    rows = rows.withColumns({f"{k}_rate": F.lit(stages.get(k, float("inf"))) for k in ("read", "cdc", "hash", "seal")})
    rows = rows.withColumn("codec_rate", formats.mib_per_second(F.col("bytes_in"), F.col("wall"))).withColumn("total_bytes", F.lit(sized["total_bytes"])).withColumn("churn_pct", F.lit(churn_pct).cast("double"))
    rows = policy.incremental(policy.policy_rows(rows, threads, sized["bookkeeping_bytes"]), threads)
    held = [r.asDict() for r in rows.orderBy("ord").collect()]
    table = spark.createDataFrame([(r["ord"], r["policy"], r["cpu_seconds"], r["steady_bytes"], r["stored_bytes"]) for r in held], "ord int, policy string, cpu_seconds double, steady_bytes long, stored_bytes long")
    initial: dict[int, dict[int, float]] = {}
    for r in policy.bandwidth(table, links).collect():
        initial.setdefault(r.ord, {})[r.mbit] = r.seconds
    best = policy.recommend_policy(table).first()
    placed = chunks.select("chunk_id", "path").join(policy.chosen(unique).filter(F.col("policy") == (best.policy if best else "zstd3")).select("chunk_id", "raw_len", "stored_len"), "chunk_id")
    return {
        "rates": stages,
        "threads": threads,
        "policies": [r | {"initial_seconds": initial.get(r["ord"], {})} for r in held],
        "recommended_policy": best.policy if best else None,
        "classes": [r.asDict() for r in policy.class_rollup(placed).collect()],
    }


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def _human(size: float) -> str:
    units, k = ("B", "KiB", "MiB", "GiB", "TiB"), 0
    while size >= 1024 and k < 4:
        size, k = size / 1024, k + 1
    return f"{size:.0f} B" if k == 0 else f"{size:.2f} {units[k]}"


def _label(size: int) -> str:
    return f"{size >> 20}M" if size and size % (1 << 20) == 0 else f"{size >> 10}K" if size and size % (1 << 10) == 0 else f"{size}B"


def _table(head: list[str], rows: list[list[str]], marks: list[str]) -> list[str]:
    wide = [max(map(len, column)) for column in zip(head, *rows, strict=True)]
    lines = ["  ".join(x.rjust(n) for x, n in zip(row, wide, strict=True)) for row in (head, *rows)]
    return [lines[0], *(line + mark for line, mark in zip(lines[1:], marks, strict=True))]


def as_text(report: dict) -> str:
    """The report as tables."""
    best, against = report["recommended"], report["baseline"] is not None
    out = [f"{report['root']}: {report['files']} files, {_human(report['dataset_bytes'])}", *([f"baseline: {report['baseline']}"] if against else []), f"bookkeeping for {report['snapshots']} snapshots", ""]
    columns = {"chunks": "total_chunks", "unique": "unique_chunks", "dedup": "dedup_ratio", "mean": "mean_len", "p50": "p50", "p95": "p95", "index": "index_bytes", "manifest": "manifest_bytes", "bookkeeping": "bookkeeping_bytes"} | ({"overlap %": "overlap_pct"} if against else {})
    show = {"total_chunks": str, "unique_chunks": str, "dedup_ratio": "{:.3f}".format, "overlap_pct": "{:.2f}".format}
    rows = [[_label(c["target_size"]), *(show.get(k, _human)(c[k]) for k in columns.values())] for c in report["candidates"]]
    out += _table(["target", *columns], rows, ["  <- recommended" if c["target_size"] == best else "" for c in report["candidates"]])
    if "policies" in report:
        links = sorted({mbit for p in report["policies"] for mbit in p["initial_seconds"]})
        out += ["", "MiB a second: " + ", ".join(f"{k} {v:.1f}" for k, v in sorted(report["rates"].items())) + f"; threads {report['threads']}"]
        rows = [[p["policy"], f"{p['ratio']:.3f}", _human(p["stored_bytes"]), _human(p["steady_bytes"]), f"{p['cpu_seconds']:.3f}", *(f"{p['initial_seconds'][m]:.2f}" for m in links), _human(p["incremental_stored"]) if p["churn_source"] else "-", f"{p['incremental_seconds']:.3f}" if p["churn_source"] else "-", p["churn_source"] or "unknown"] for p in report["policies"]]
        out += _table(["policy", "ratio", "stored", "steady", "CPU s", *(f"s at {m} Mbit" for m in links), "increment", "its s", "churn"], rows, ["  <- recommended" if p["policy"] == report["recommended_policy"] else "" for p in report["policies"]])
        out += [f"{c['class']}: {_human(c['bytes_in'])} to {_human(c['bytes_out'])}, {100 * c['share_of_savings']:.1f} % of savings" for c in report["classes"]]
    return "\n".join(out)
