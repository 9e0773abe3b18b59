import importlib
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import decontaminate, near_join, quality
from tessera.llm._cluster import salted_join, shared_dir
from tessera.llm._labelled import sampled
from tessera.llm.components import components
from tests.llm import test_decontaminate, test_mixing, test_near_join
from tests.llm.helpers import ODD, words
from tests.llm.helpers import docs as make_docs

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if k == 0:
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r.doc_id for r in quality.scored(before, model).collect() if r.score >= 0.3]
            assert sorted(i for i, _ in kept[name]) == sorted(want)
        elif k == 1:
            want = {r[1] for r in test_near_join.brute(rows)}
            assert sorted(i for i, _ in kept[name]) == sorted(want)
        elif k == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = [r[0] for r in test_decontaminate.brute(rows, items) if not r[5]]
            assert sorted(i for i, _ in kept[name]) == sorted(want)
        elif k == 3:
            sizes, taken = {}, {}
            source = {r.doc_id: r.source for r in before.collect()}
            for i, t in rows:
                sizes[source[i]] = sizes.get(source[i], 0) + test_mixing.size(t)
            for i, t in kept[name]:
                taken[source[i]] = taken.get(source[i], 0) + test_mixing.size(t)
            order = sorted(sizes)
            assert {s: taken.get(s, 0) for s in order} == {s: int(t) for s, t in zip(order, test_mixing.targets([sizes[s] for s in order]), strict=True)}
        else:
            shards = {}
            for r in docs.collect():
                shards.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(v) == list(range(len(v))) for v in shards.values())
            assert len(kept[name]) == len(rows)
    assert words("A b") == ["a", "b"] and decontaminate.WINDOW == 10 and near_join.WIDTH == 5


def _through(spark, tmp_path, docs):
    """What each stage keeps, written and read again."""
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null, empty, wordless, repeated and very long texts, null ids and sources, and columns of clashing names."""
    some = [(r.doc_id + 1000, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    odd = [(i, t, s) for (i, t), s in zip(ODD, ["src0", None, "", "src1"] * 3, strict=False)]
    names = ("_bin", "_begin", "_spans", "_draws", "n_links", "class_id", "words", "start", "stop", "items")
    docs = make_docs(spark, [*some, *odd, (50, "x" * 300_000, None), (51, "word " * 100_000, "src0")], extra=True)
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    kept = _through(spark, tmp_path, docs)
    for before, after in zip(kept, kept[1:], strict=False):
        assert after.count() <= 4 * max(1, before.count())
    for frame in kept[1:-1]:
        assert frame.columns == docs.columns
        assert frame.select("_bin", "_spans", "_draws", "key", "rep").distinct().count() <= 1
    last = kept[-1]
    assert [c for c in last.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")]
    assert {(r._bin, r.key, r.words) for r in last.collect()} <= {("mine", "mine", "mine")}
    ids = [r.doc_id for r in kept[2].collect()]
    assert len(ids) == len(set(ids)) or ids.count(None) > 1


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    assert [f.count() for f in _through(spark, tmp_path, make_docs(spark, []))] == [0] * 6


def test_intermediate_folders_go(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("pipeline-*"))
    P.run(spark, SF)
    assert len(set(folder.glob("pipeline-*")) - before) == 1


def test_one_key_of_many_rows(spark):
    """A hub of components, and a join in which a third of the rows have one key."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5100)] + [(2999, 5000)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.root for r in found.collect()} == {0} and found.count() == 3000 + 101
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = salted_join(rows, keyed, "k", "v")
    assert got.count() == 3000 and got.filter("k = 0").agg(F.sum("n"), F.count("*")).first() == (1_000_000, 1000)


def test_a_sample_of_labels_is_bounded_and_repeatable(spark):
    docs = make_docs(spark, [(i, f"t{i}") for i in range(300)] + [(7, "other")])
    labels = spark.createDataFrame([(i, i % 3 == 0, 0) for i in range(300)] + [(None, True, 0)], "doc_id long, quality boolean, toxic int")
    got, counts = sampled(docs, labels, "quality", 5, 0, rows=20)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == 40 and sum(r[1] for r in rows) == 20 and sum(counts.values()) < 300
    assert rows == sorted(map(tuple, sampled(docs, labels, "quality", 5, 0, rows=20)[0].collect()))


def test_run_is_the_stages(spark):
    assert P.run(spark, SF).count() == P.run(spark, SF).count() > 0


def test_the_library_stands_without_this_subpackage():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sizing_report' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("pathlib").Path(P.__file__).parent)
