import collections
import math
import re
from decimal import Context, Decimal, localcontext

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tests.llm.helpers import ODD, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(sizes, weights=M.WEIGHTS, copies=M.COPIES):
    """What each source shall give, by brute force."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        shared = sum(weight[i] for i in open_)
        over = [i for i in open_ if rest * weight[i] / shared > copies * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weight[i] / shared
            break
        for i in over:
            out[i] = float(copies * sizes[i])
        open_ -= set(over)
        rest -= sum(out[i] for i in over)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(enumerate(sizes)), "rank long, source_size long")
    got = [r.target for r in M.targeted(frame).orderBy("rank").collect()]
    assert got == pytest.approx(targets(sizes))
    assert all(t <= 3 * n + 1e-6 for t, n in zip(got, sizes, strict=True))
    assert abs(sum(got) - sum(sizes)) <= 1e-6 * max(1, sum(sizes))


def test_sources_rank_by_code_point(spark):
    names = ["b", "a", "é", "😀", "\uffee", "B", "", None, "ab"]
    got = M.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long"), 400_000).orderBy("rank").collect()
    assert [r.source for r in got] == sorted([n for n in names if n is not None]) + [None]
    assert [r["rank"] for r in got] == list(range(9))


def test_large_draws_have_the_exact_weights():
    assert float(M.log_factorial(600)) == pytest.approx(math.lgamma(601), rel=1e-14)
    with localcontext(Context(prec=100)):
        whole = Decimal(math.factorial(1000)).ln()
        assert abs(M.log_factorial(1000) - whole) < Decimal("1e-60")
    rng = np.random.default_rng(4)
    for good, bad, draws in ((6, 4, 5), (4, 9, 10), (30, 3, 12)):
        seen = collections.Counter(M._large_draw(rng, good, bad, draws) for _ in range(4000))
        for k in range(draws + 1):
            want = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if draws - k <= bad else 0
            assert abs(seen[k] / 4000 - want) < 0.035
    n = 10**13
    z = [(M._large_draw(rng, n, 3 * n, n) - n / 4) / math.sqrt(n * 0.25 * 0.75 * 0.75) for _ in range(60)]
    assert abs(np.mean(z)) < 0.5 and 0.7 < np.std(z) < 1.3


def test_places_beyond_64_bits(spark):
    """The permutation of ten thousand million blocks, whose product with its step is beyond 64 bits."""
    n = 10**10
    step, at = M._step(n, 3), [0, 1, 7 * 10**9, n - 1]
    frame = spark.createDataFrame([(b,) for b in at], "b long")
    wide = lambda x: F.lit(x).cast("decimal(38,0)")
    got = frame.select(F.pmod(F.col("b").cast("decimal(38,0)") * wide(step) + wide(5), wide(n)).cast("long")).collect()
    assert [r[0] for r in got] == [(b * step + 5) % n for b in at]
    assert math.gcd(step, n) == 1


def test_many_groups_of_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_SOURCES", 4)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    rows = [(i, prose(i, 5 + i * 37 % 200), f"s{i % 23}" if i % 9 else None) for i in range(200)]
    got = mixed_rows(spark, rows, block=16)
    check(rows, got)
    shards = collections.Counter(d.shard for r in got for d in r.draws)
    assert len(shards) == M.SHARDS


def test_shards_hold_their_leaves(spark):
    """Each shard's draws of each source are its leaf of the tree, and another tree deals them otherwise."""
    rows = [(i, prose(i, 100), f"s{i % 3}") for i in range(60)]
    frame = docs(spark, rows)
    source = {i: s for i, _, s in rows}
    held = {}
    for seed in (M.SEED, 5):
        held[seed] = collections.defaultdict(set)
        for r in M.mixture(frame, shards=4, block=32, seed=seed).collect():
            for d in r.draws:
                held[seed][d.shard, source[r.doc_id]].add(d.place)
        by = M.plan(frame.groupBy("source").agg(F.sum(M.words(F.col("text"))).alias("source_size")), 3, 4, 32, seed)
        for line in by.collect():
            leaves = np.diff([0, *line._ends])
            assert [len(held[seed][k, line.source]) for k in range(4)] == list(leaves)
    assert {k: len(v) for k, v in held[5].items()} != {k: len(v) for k, v in held[M.SEED].items()}


def test_mixed_rows_stand_by_shard_and_place(spark):
    """The pieces of a shard stand together in each task, in the order of their places."""
    rows = [(i, prose(i, 100), f"s{i % 3}") for i in range(60)]
    frame = docs(spark, rows)
    where = {}
    for r in M.mixture(frame, block=32).collect():
        for d in r.draws:
            key = (r.doc_id, d["pass"], d.shard)
            where[key] = min(where.get(key, d.place), d.place)
    pieces = M.mixed(frame, block=32)
    assert pieces.count() == len(where)
    by_task = collections.defaultdict(list)
    for r in pieces.withColumn("task", F.spark_partition_id()).collect():
        by_task[r.task].append((r.doc_id, size(r.text)))
    assert sum(len(v) for v in by_task.values()) == len(where)
    orders = {task: [i for i, _ in v] for task, v in by_task.items()}
    assert any(v != sorted(v) for v in orders.values())


def test_the_tree_deals_all_draws():
    for counts in ([5, 0, 17, 200], [0], [1, 1], [3 * 10**9, 10**9]):
        leaves = M.split_tree(counts, 16)
        assert [sum(x) for x in zip(*leaves, strict=True)] == counts
        assert all(n >= 0 for leaf in leaves for n in leaf)
        totals = [sum(leaf) for leaf in leaves]
        assert max(totals) - min(totals) <= 1
    assert M.split_tree([50, 70]) == M.split_tree([50, 70])


def mixed_rows(spark, rows, **kw):
    return M.mixture(docs(spark, rows, extra=True), **kw).collect()


def check(rows, got):
    assert len(got) == len(rows)
    sources = {}
    for r in rows:
        source = r[2] if len(r) > 2 else "src0"
        sources[source] = sources.get(source, 0) + size(r[1])
    order = sorted(sources, key=lambda x: (x is None, x or ""))
    want = dict(zip(order, targets([sources[s] for s in order]), strict=True))
    taken = {}
    for r in got:
        for d in r.draws:
            assert 0 <= d.start < d.stop <= r.size and 0 <= d.shard < M.SHARDS
        n = sum(d.stop - d.start for d in r.draws)
        assert n <= 3 * r.size
        taken[r.target] = taken.get(r.target, 0) + n
    for target in set(want.values()):
        same = [s for s in want if want[s] == target]
        assert taken.get(target, 0) == sum(int(want[s]) for s in same)


def test_odd_rows(spark):
    check(ODD, mixed_rows(spark, ODD))
    assert mixed_rows(spark, []) == []
    none = [(1, None, None), (2, "", "a")]
    assert all(r.size == 0 and r.draws == [] and r.target == 0 for r in mixed_rows(spark, none))


def test_targets_are_met_to_the_word(spark):
    rows = [(i, prose(i, 5 + i * 37 % 200), f"s{i % 7}" if i % 9 else None) for i in range(200)] + [(900 + i, prose(i, 400), "hot") for i in range(90)]
    for block in (16, 1024):
        got = mixed_rows(spark, rows, block=block)
        check(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixed_rows(spark, rows)))


def test_draws_are_disjoint_and_shards_exact(spark):
    rows = [(i, prose(i, 100), f"s{i % 3}") for i in range(60)]
    got = mixed_rows(spark, rows, block=32)
    seen = set()
    for r in got:
        for d in r.draws:
            for w in range(d.start, d.stop):
                key = (r.doc_id, d["pass"], w)
                assert key not in seen
                seen.add(key)
    places = {}
    for r in got:
        for d in r.draws:
            places.setdefault(d.shard, set()).add(d.place)
    sizes = [len(v) for v in places.values()]
    assert len(places) == M.SHARDS and max(sizes) - min(sizes) <= 1


def test_texts_are_cut_to_the_words_taken(spark):
    rows = [(i, prose(i, 60), f"s{i % 4}") for i in range(40)] + [(99, None, "s1"), (50, prose(50, 9), "s0"), (50, prose(50, 9), "s0")]
    frame = docs(spark, rows, extra=True)
    out = M.mixed(frame, block=16).collect()
    assert M.mixed(frame).columns == frame.columns
    taken, made = {}, {}
    for r in M.mixture(frame, block=16).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + sum(d.stop - d.start for d in r.draws)
    for r in out:
        made[r.doc_id] = made.get(r.doc_id, 0) + size(r.text)
        assert r.n_chars == len(r.text) and r.size == "mine"
    assert made == {k: v for k, v in taken.items() if v}


def test_op3_deals_draws_to_shards_in_order(spark):
    shards = {}
    for r in M.op3_mixing(spark, "/root/testdata/sf0.001").collect():
        draws = [tuple(map(int, x.split(":"))) for x in r.dealt.split(",") if x]
        assert draws == sorted(draws) and sum(d[4] - d[3] for d in draws) == r.taken
        for shard, place, *_ in draws:
            shards.setdefault(shard, set()).add(place)
    sizes = [len(v) for v in shards.values()]
    assert sorted(shards) == list(range(M.SHARDS)) and max(sizes) - min(sizes) <= 1
