import collections
import random

import pytest

from tessera.llm import near_join as N
from tessera.llm.components import components
from tests.llm.helpers import ODD, docs, prose, words
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.8):
    """class_id, n_links, copy_id, n_copies by row number."""
    sets = []
    for doc_id, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and doc_id is not None else None)
    classes = collections.defaultdict(list)
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s is not None:
            classes[s].append(doc_id)
    reps = {s: min(ids) for s, ids in classes.items()}
    keys, root = list(classes), {s: s for s in classes}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    links = collections.Counter()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for s in keys:
        least[find(s)] = min(least.get(find(s), 2**62), reps[s])
    return sorted(
        ((r[0], r[0], 0, r[0], 1) if s is None else (r[0], least[find(s)], links[s], reps[s], len(classes[s])) for r, s in zip(rows, sets, strict=True)), key=str
    )


def run(spark, rows, **kw):
    got = N.joined(docs(spark, rows, extra=True), **kw).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")
    return sorted((tuple(r) for r in got.collect()), key=str)


def family(seed, n, length=120, edits=2):
    rng, base = random.Random(seed), prose(seed, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = [t for seed in range(6) for t in family(seed, 7)] + [prose(100 + i, 60) for i in range(30)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rows = [(i, t) for i, t in enumerate(family(3, 90, 100, 3))] + [(1000 + i, prose(i, 50)) for i in range(10)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, [(1, None)]) == [(1, 1, 0, 1, 1)]
    assert N.joined(docs(spark, [])).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (5, a), (5, b), (9, b)]
    got = run(spark, rows)
    assert {r[1] for r in got} == {1}


def test_one_of_each_class_stays(spark):
    rows = [*ODD, (20, prose(4, 80)), (21, prose(4, 80)), (22, prose(4, 80) + " more"), (23, prose(5, 80))]
    kept = N.deduplicated(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, rows, extra=True).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, None, 7, 8, 20, 23], key=str)


def test_the_floor_follows_the_recall():
    assert N.floor_depth(0.8, 24, 0.999) == 6 and N.floor_depth(0.8, 24, 0.9999) == 5
    assert N.floor_depth(0.9, 24, 0.9999) > 5
    assert N.floor_depth(0.8, 1, 0.999999) == 1


def _forest(spark, labels, **kw):
    """Ties of some sets with given labels: a list of tuples of bytes for each tree."""
    value = lambda label: int.from_bytes(bytes(label), "big", signed=True)
    frame = spark.createDataFrame([(rep, [value(x) for x in of]) for rep, of in labels.items()], "rep long, labels array<long>")
    return {(r.a, r.b) for r in N.ties(frame, kw.get("threshold", 0.8), len(next(iter(labels.values()))), kw.get("recall", 0.9999)).collect()}


def test_ties_join_what_shares_a_prefix(spark):
    """Components of the ties at the floor are those of sets that share a prefix of that length in some tree."""
    rng = random.Random(9)
    trees = 6
    floor = N.floor_depth(0.8, trees, 0.9)
    labels = {i: [tuple(rng.choice((7, 250)) for _ in range(8)) for _ in range(trees)] for i in range(30)}
    got = _forest(spark, labels, recall=0.9)

    def parts(pairs):
        root = {i: i for i in labels}
        for _ in labels:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    # at most what the floor joins, and all that whole labels join
    shared = lambda d: [(a, b) for a in labels for b in labels if a < b and any(x[:d] == y[:d] for x, y in zip(labels[a], labels[b], strict=True))]
    at_floor, whole, mine = parts(shared(floor)), parts(shared(8)), parts(got)
    assert all(at_floor[a] == at_floor[b] for a, b in got)
    assert all(mine[a] == mine[b] for a, b in shared(8)) and len(set(whole.values())) >= len(set(mine.values()))
    # none of these sets has similar partners, so all go down to the floor
    assert mine == at_floor


def test_prefixes_are_shortened_only_as_far_as_needed(spark):
    """Sets that agree in nearly all trees stop at long prefixes, so that one short prefix in common doesn't tie two groups."""
    trees = 24
    one = {i: [(1, 2, 3, 4, 5, 6, 7, t) for t in range(trees)] for i in (1, 2, 3)}
    two = {i: [(9, 2, 3, 4, 5, 6, 7, t) for t in range(trees)] for i in (11, 12, 13)}
    for labels in two.values():
        labels[0] = (1, 2, 3, 4, 5, 99, 99, 99)  # five components in common with the first group
    got = _forest(spark, one | two)
    assert {(2, 1), (12, 11)} <= got and not any(a > 10 > b for a, b in got)
    # a set of which nothing is known goes down to the floor
    alone = {20: [(1, 2, 3, 4, 5, 77, 77, 77)] + [(50 + t, 2, 3, 4, 5, 6, 7, 8) for t in range(trees - 1)]}
    assert any(a == 20 or b == 20 for a, b in _forest(spark, one | alone))


def test_tasks_meet_at_their_seams(spark):
    labels = {i: [(1, 2, 3, 4, 5, 6, 7, 8)] * 24 for i in range(200)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = _forest(spark, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = {i: i for i in labels}
    for _ in range(20):
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {0}


def test_recall_at_the_threshold(spark):
    """Of pairs just above the threshold at least 99 of a hundred are found."""
    rng = random.Random(11)
    rows, near = [], 0
    for k in range(300):
        base = [f"b{k}x{i}" for i in range(204)]
        other = list(base)
        for at in rng.sample(range(10, 194, 6), 4):
            other[at] = f"e{k}x{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = (frozenset(tuple(w[i : i + 5]) for i in range(200)) for w in (base, other))
        near += len(a & b) >= 0.8 * len(a | b)
    got = N.joined(docs(spark, rows)).filter("n_links > 0").count() / 2
    assert near == 300 and got >= 0.99 * near


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_matches_sql(spark, sf):
    assert rows_of(N.op2_near_join(spark, sf)) == rows_of_sql(connect(sf), N.OP2_SQL)
