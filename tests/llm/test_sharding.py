import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding as S
from tests.llm.helpers import ODD, docs, prose


def minimax(sizes, shards):
    """The least largest part over all contiguous cuts."""
    best = sum(sizes)
    for at in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        at = (0, *at, len(sizes))
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_least(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "BITS", 3)
    rng = random.Random(seed)
    keys = sorted(rng.randrange(-(2**63), 2**63) for _ in range(14))
    sizes = [rng.choice([1, 2, 5, 9, 60 if seed == 2 else 3]) for _ in keys]
    groups = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, bytes long")
    found, capacity = S.cuts(groups, 4)
    assert capacity == minimax(sizes, 4)
    parts = [0] * 4
    for k, n in zip(keys, sizes, strict=True):
        parts[sum(k >= c for c in found)] += n
    assert max(parts) == capacity


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= k < shards for k in by)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    where = {}
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, set()).add(text or "")
    for r in got:
        for t in texts[r.doc_id] if len(texts[r.doc_id]) == 1 else ():
            assert where.setdefault(t, r.shard) == r.shard
            assert r.size == len(t.encode()) + 1
            assert r.text_crc32 == zlib.crc32(t.encode())


def test_odd_rows(spark):
    check(ODD, S.assignments(docs(spark, ODD, extra=True)).collect())
    assert S.assignments(docs(spark, [])).count() == 0
    assert S.sharded(docs(spark, [])).count() == 0
    out = S.sharded(docs(spark, ODD, extra=True).withColumn("_bin", F.lit("mine")).withColumn("_begin", F.lit("mine")))
    assert {(r.key, r._bin, r._begin, r.rank) for r in out.collect()} == {("mine", "mine", "mine", "mine")}
    check(ODD, out.withColumn("size", S.text_bytes(F.col("text"))).withColumn("text_crc32", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))).collect())


def test_sizes_are_near_and_repeat(spark):
    rows = [(i, prose(i, 40)) for i in range(600)]
    got = S.assignments(docs(spark, rows)).collect()
    check(rows, got)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8 + 300
    assert sorted(map(str, got)) == sorted(map(str, S.assignments(docs(spark, rows)).collect()))


def test_one_group_of_a_third(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", 10)
    rows = [(i, "copy of one text" if i % 3 == 0 else prose(i, 3)) for i in range(300)]
    got = S.assignments(docs(spark, rows)).collect()
    check(rows, got)
    counts = {r.shard for r in got}
    assert counts == set(range(8))
