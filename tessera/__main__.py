"""Commands over a store: backup, run (backups on a schedule), list, restore, prune, gc, status, and size for the sizing report."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from tessera.archive import Archive
from tessera.operators import policy
from tessera.plans import report
from tessera.streaming import upkeep


def _size(text: str) -> int:
    text = text.strip()
    unit = {"k": 1 << 10, "m": 1 << 20}.get(text[-1:].lower())
    return int(text[:-1]) * unit if unit else int(text)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--now-ms", type=int, default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("backup", "run", "list", "restore", "prune", "gc", "status"):
        c = sub.add_parser(name)
        c.add_argument("--store", required=True)
        if name in ("backup", "run"):
            c.add_argument("roots", nargs="+")
            c.add_argument("--owner")
            c.add_argument("--target-size", type=_size, default=1 << 20)
            c.add_argument("--policy", default="escalate")
            c.add_argument("--auto-prune", action="store_true")
            if name == "run":
                c.add_argument("--interval", type=float, default=10_800.0, help="seconds between runs")
                c.add_argument("--jitter", type=float, default=0.1)
                c.add_argument("--runs", type=int, help="how many; without end if not given")
        elif name == "restore":
            c.add_argument("snapshot")
            c.add_argument("target")
        elif name == "gc":
            c.add_argument("--grace-s", type=int, default=3600)
    c = sub.add_parser("size")
    c.add_argument("root")
    c.add_argument("--sizes", type=_size, nargs="+", default=list(report.SIZES))
    c.add_argument("--baseline")
    c.add_argument("--snapshots", type=int)
    c.add_argument("--compression", action="store_true")
    c.add_argument("--assume-churn", type=float)
    c.add_argument("--threads", type=int, help="as many as run at once, if not given")
    c.add_argument("--links", type=int, nargs="+", default=list(policy.BANDWIDTHS))
    c.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    now = a.now_ms if a.now_ms is not None else int(time.time() * 1000)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "size":
        made = report.sizing_report(spark, a.root, tuple(a.sizes), a.baseline, a.snapshots, a.compression, a.assume_churn, a.threads, tuple(a.links))
        print(report.as_json(made) if a.json else report.as_text(made))
        return
    store = Archive(spark, a.store)
    if a.command == "run":
        upkeep.run_loop(lambda at: store.backup(a.roots, at, a.owner, a.target_size, a.policy, a.auto_prune), a.interval, a.jitter, lambda tick: print(json.dumps(tick, default=str), flush=True), runs=a.runs)
        return
    if a.command == "list":
        store.list().show(1000, truncate=False)
        return
    done = {
        "backup": lambda: store.backup(a.roots, now, a.owner, a.target_size, a.policy, a.auto_prune),
        "restore": lambda: store.restore(a.snapshot, a.target),
        "prune": lambda: store.prune(now),
        "gc": lambda: store.gc(now, a.grace_s * 1000),
        "status": store.status,
    }[a.command]()
    print(json.dumps(done, indent=2, default=str))


if __name__ == "__main__":
    main()
