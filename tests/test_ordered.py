import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, ordered


@pytest.fixture
def rows(spark):
    """A third of the rows have one key."""
    rng = random.Random(3)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.randrange(100)) for i in range(900)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "root string, seq long, len long").repartition(5)


def test_sums_along_an_order(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 100)
    got = ordered.along(frame(spark, rows), "root", ["seq"], {"n": F.lit(1).cast("long"), "size": F.col("len")})
    assert got.rdd.getNumPartitions() >= 1 and got.columns == ["root", "seq", "len", "n", "size"]
    want = []
    for _, of in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        n = size = 0
        for r in of:
            n, size = n + 1, size + r[2]
            want.append((*r, n, size))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ordered.along(frame(spark, []), "root", ["seq"], {"n": F.lit(1)}).count() == 0


def test_running_sums_of_many_places(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RUN", 7)
    rng = random.Random(1)
    places = [(k, at, rng.randrange(9)) for k in ("a", "b") for at in range(100) if rng.random() < 0.8]
    got = ordered.running(spark.createDataFrame(places, "k string, at long, n long"), ["k"], "at", "n", "before")
    want = {(k, at): sum(n for k2, at2, n in places if k2 == k and at2 < at) for k, at, _ in places}
    assert {(r.k, r["at"]): r.before for r in got.collect()} == want


def test_folds_cross_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = dedup.batches(frame(spark, rows), 5, 150).collect()
        last = ordered.folded(frame(spark, rows), "root", ["seq"], lambda: ("", 0), lambda s, r: ((r[0], s[1] + 1), []) if r else (s, [s]), "root string, n long", [pa.string(), pa.int64()]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for _, of in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        number = n = size = 0
        for r in of:
            want.append((*r, number))
            n, size = n + 1, size + r[2]
            if n >= 5 or size >= 150:
                number, n, size = number + 1, 0, 0
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.root: r.n for r in last} == {k: len(list(of)) for k, of in itertools.groupby(sorted(r[0] for r in rows))}
    assert dedup.batches(frame(spark, []), 5, 150).count() == 0
