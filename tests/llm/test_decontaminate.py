import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as D
from tests.llm.helpers import ODD, docs, words
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def brute(rows, items, window=10):
    cut = []
    for item_id, text in items:
        w = words(text)
        cut += [(item_id, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for item_id, win in cut:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items, window=10):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("words", F.lit(1))
    got = D.contamination(docs(spark, rows, extra=True), bench, window)
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()), key=str)


def test_odd_rows(spark):
    items = [(1, "one two three four five six"), (2, "One"), (3, None), (4, ""), (5, "word word"), (6, "two three"), (None, "five"), (7, "absent here"), (8, "one two three four five six seven eight nine ten eleven")]
    assert run(spark, ODD, items) == brute(ODD, items)
    assert run(spark, ODD, []) == brute(ODD, [])
    assert run(spark, [], items) == []


def test_short_windows_over_few_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    for window in (2, 4, 10):
        assert run(spark, rows, items, window) == brute(rows, items, window)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aÉé -B", max_size=25), min_size=1, max_size=6), st.lists(st.text("aÉé B", max_size=12), max_size=4))
def test_any_texts(spark, texts, items):
    rows, items = list(enumerate(texts)), list(enumerate(items))
    assert run(spark, rows, items, 3) == brute(rows, items, 3)


def test_more_windows_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 5)
    rows = [(1, "a b c d e f g h i j k l m"), (2, "x y z")]
    items = [(1, "a b c d e f g h i j k l"), (2, "y z"), (3, "z")]
    assert run(spark, rows, items) == brute(rows, items)


def test_windows_of_more_bytes_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 300)
    rows = [(i, " ".join(f"{'long' * 20}{j}" for j in range(i, i + 14))) for i in range(8)]
    items = [(i, rows[i][1]) for i in (0, 3, 5)]
    assert run(spark, rows, items) == brute(rows, items)


def test_one_window_in_many_items_and_documents(spark):
    passage = "a b c d e f g h i j"
    rows = [(i, f"x{i} {passage} y{i}") for i in range(60)] + [(99, "clean")]
    items = [(i, f"{passage} z{i}") for i in range(40)]
    assert run(spark, rows, items) == brute(rows, items)


def test_clean_documents_stay(spark):
    rows = [(1, "this is clean"), (2, None), (3, "leaks a b c d e f g h i j here"), (4, "A, B; c d e f g h i j"), (None, "")]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    kept = D.clean(docs(spark, rows, extra=True), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]


def test_matches_sql(spark):
    assert rows_of(D.op8_decontamination(spark, SF)) == rows_of_sql(connect(SF), D.OP8_SQL)
