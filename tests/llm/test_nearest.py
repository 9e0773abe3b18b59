import numpy as np
from pyspark.sql import functions as F

from tessera.llm import nearest as A

SCHEMA = "vec_id long, embedding array<float>, label int, part string, floor string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "mine", "mine", "mine") for i, v in rows], SCHEMA)


def run(spark, rows, **kw):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(frame(spark, rows), F.col("vec_id") % 20 == 0, **kw).collect())


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            score = x @ q
            order = sorted((-s, j) for s, j in zip(score, ids, strict=True) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def recall(got, want):
    found = {}
    for q, _, j, _ in got:
        found.setdefault(q, set()).add(j)
    return sum(len(found.get(q, set()) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "SAMPLE_ROWS", 700)
    monkeypatch.setattr(A, "SAMPLE_QUERIES", 100)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = run(spark, rows, parts=8)
    want = brute(range(3000), x.astype(np.float64))
    assert recall(got, want) >= 0.9
    assert len(got) == 20 * len(want)
    for q, rank, j, s in got[:200]:
        assert abs(s - float(x[q].astype(np.float64) @ x[j].astype(np.float64))) < 1e-9
        assert 1 <= rank <= 20 and q != j
    assert got == run(spark, rows, parts=8)


def _routes_alone(spark, monkeypatch, x, **changed):
    """Recall, and the share of all rows that were scored for a query."""
    for name, value in changed.items():
        monkeypatch.setattr(A, name, value)
    rows = frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(rows, F.col("vec_id") % 20 == 0).collect())
    held = A.valid(rows).select(F.col("vec_id").alias("id"), "embedding")
    placed, sent = A.indexed(held, held.filter("id % 20 = 0"), len(x))
    sizes = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}
    assert sum(sizes.values()) == len(x)
    scored = sum(sizes.get(r[0], 0) * r[1] for r in sent.groupBy("part").count().collect())
    return recall(got, brute(range(len(x)), x.astype(np.float64))), scored / len(x) / (len(x) / 20), len(sizes)


def test_routes_alone_on_clusters(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] * 3 + rng.normal(size=(6000, 16))).astype(np.float32)
    found, scored, parts = _routes_alone(spark, monkeypatch, x, SAMPLE_ROWS=2000, SAMPLE_QUERIES=200, ROWS_PER_PART=200)
    assert found >= 0.9 and scored < 0.3 and parts > 16


def test_routes_alone_on_a_cloud_without_clusters(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(4000, 24)).astype(np.float32)
    found, scored, _ = _routes_alone(spark, monkeypatch, x, SAMPLE_ROWS=2000, SAMPLE_QUERIES=200, ROWS_PER_PART=500)
    assert found >= 0.9 and scored < 0.95


def test_large_parts_are_divided_again(spark, monkeypatch):
    """With networks of few parts the index has several levels, and the parts stay small."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 12))[rng.integers(0, 40, 6000)] * 3 + rng.normal(size=(6000, 12))).astype(np.float32)
    found, scored, parts = _routes_alone(spark, monkeypatch, x, SAMPLE_ROWS=1000, SAMPLE_QUERIES=200, FAN=4, ROWS_PER_PART=100, SPLIT_ROWS=600, SLICE_ROWS=300)
    assert found >= 0.9 and scored < 0.6 and parts > 10


def test_an_id_with_several_vectors_counts_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    ids = [i % 100 for i in range(300)]
    got = run(spark, [(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)])
    by = {}
    for q, rank, j, s in got:
        by.setdefault(q, []).append((rank, j, s))
    d = x.astype(np.float64)
    for q, found in by.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({j for _, j, _ in found}) == 20
        best = {j: max(float(d[a] @ d[b]) for a in range(300) if ids[a] == q for b in range(300) if ids[b] == j) for _, j, _ in found}
        assert q not in best and all(abs(best[j] - s) < 1e-9 for _, j, s in found)


def test_one_vector_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = run(spark, rows, parts=4)
    want = brute(range(900), x.astype(np.float64))
    mine = {}
    for q, _, j, _ in got:
        mine.setdefault(q, []).append(j)
    assert recall(got, want) >= 0.9
    assert mine[0] == want[0]  # equal scores: the smaller ids


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (40, None), (60, [0.0, 0.0])]
    got = run(spark, rows)
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(2, None), (4, [0.0])]) == []


def test_parts_are_equal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    part = A.balanced_parts(A.neighbour_graph(x), 8)
    counts = np.bincount(part, minlength=8)
    assert counts.max() - counts.min() <= 3
    ring = np.column_stack([np.cos(np.arange(400) / 400 * 6.283), np.sin(np.arange(400) / 400 * 6.283)])
    halves = A.balanced_parts(A.neighbour_graph(ring, 4), 2)
    assert (halves != np.roll(halves, 1)).sum() <= 20
