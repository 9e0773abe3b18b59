"""N-gram Jaccard join of documents by a MinHash LSH forest with exact verification.

A document is the set of its runs of five words (a shorter text is one run). Documents of equal sets are one copy
class, of which one member goes on. Every set has `TREES` labels of `MAX_DEPTH` MinHash components of eight bits, the
first in the highest bits. Each tree's labels are sorted, and what each label has in common with the one before it
makes the sorted labels a prefix trie: a label's node of that depth begins at the first label that shares the prefix.

Prefixes are shortened adaptively. The floor is the longest prefix at which two sets of exactly the threshold's
similarity meet in some tree with probability `RECALL`. In how many trees two sets share a prefix of that length tells
how similar they are, and so how likely they are to share a longer one in some tree. A set whose similar partners would
all be found by a longer prefix, to an expected share of `RECALL`, uses the longest such; one without similar partners,
of which nothing is known, goes down to the floor. A label is tied to the first of its node if the prefix is as long
as either set needs.

Candidates are never written as pairs: ties are one a label. Their connected components are formed, and all pairs
inside a component are compared exactly, in blocks of at most `BLOCK_ROWS` documents, by counting common shingles; a
task returns the number of links of each document and a spanning forest of its links. So a group of any size is dealt
over many tasks, and no link inside it is left out.

Defined results: a null or wordless text has no shingles, is linked to nothing and is a class of its own; so is a row
with a null doc_id, which is not compared; rows that share a doc_id are one document for classes and links; an empty
table gives no rows; other columns are ignored. Sets count as equal if two independent 64-bit sums over them agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._cluster import bounded_batches, checkpoint, salted_join, sliced, small, table_of
from tessera.llm._words import U, mix, shingles, words
from tessera.llm.components import components
from tessera.plans.views import spread

WIDTH = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
RECALL = 0.9999
#: Labels that one task sorts on the whole.
LABEL_ROWS = 2_000_000
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
_BITS = 8
_SECOND = U(0xA0761D6478BD642F)


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely two sets of that similarity are to share a prefix of that length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which the forest still finds a pair of the threshold's similarity with that probability."""
    return next((d for d in range(MAX_DEPTH, 1, -1) if found_share(threshold, d, trees) >= recall), 1)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[list[np.ndarray], range]]:
    """The sorted distinct shingles of each text, some texts at a time."""
    for found in words(column):
        values, bounds = shingles(found, width)
        yield [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], found.rows


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _labels(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """A label of each tree for each set that isn't empty."""
    together = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.empty((len(sets), trees * MAX_DEPTH), U)
    hashed = np.empty_like(together)
    for k, factor in enumerate(_factors(trees * MAX_DEPTH)):
        np.multiply(together, factor, out=hashed)
        least[:, k] = np.minimum.reduceat(hashed, starts)
    parts = (mix(least) & U(255)).reshape(len(sets), trees, MAX_DEPTH)
    out = np.zeros((len(sets), trees), U)
    for k in range(MAX_DEPTH):
        out = (out << U(_BITS)) | parts[:, :, k]
    return out.view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """Per row: doc_id, text_key, n (shingles), h1 and h2 (the set), labels (one of each tree; null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            total = batch.num_rows
            n, h1, h2 = (np.zeros(total, np.int64) for _ in range(3))
            labels: list = [None] * total
            for sets, rows in _sets(batch.column("text"), width):
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                some = [sets[i] for i in full]
                sizes = np.array([len(s) for s in some])
                starts, at = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array(full) + rows.start
                together = np.concatenate(some)
                n[at] = sizes
                h1[at] = np.add.reduceat(mix(together), starts).view(np.int64)
                h2[at] = np.add.reduceat(mix(together ^ _SECOND), starts).view(np.int64)
                for i, label in zip(at, _labels(some, trees), strict=True):
                    labels[i] = label
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(h1), pa.array(h2), pa.array(labels, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "h1", "h2", "labels"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.mapInArrow(sign, "doc_id long, text_key long, n long, h1 long, h2 long, labels array<long>")


def _prefix(label: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many components each label shares with the one before it."""
    apart = label.view(U) ^ before.view(U)
    return MAX_DEPTH - np.sum([apart >> U(_BITS * k) != 0 for k in range(MAX_DEPTH)], axis=0)


def _walked(floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks the sorted labels of a task: a, the first set of its node (b) and the node's depth; and the task's first and last label."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["a", "b", "depth", "part", "tree", "label"]
        path = np.zeros(MAX_DEPTH + 1, np.int64)  # of each depth the first set of the node that the last label is in
        last: tuple[int, int, int] | None = None
        ends = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, rep = (batch.column(k).to_numpy() for k in ("tree", "label", "rep"))
            if last is None:
                last = (-1, 0, 0)
                ends.append((int(rep[0]), -1, int(tree[0]), int(label[0])))
            shared = _prefix(label, np.concatenate(([last[1]], label[:-1])))
            shared[tree != np.concatenate(([last[0]], tree[:-1]))] = 0
            first = np.zeros(len(rep), np.int64)
            at = np.arange(len(rep))
            for d in range(1, MAX_DEPTH + 1):
                begins = np.maximum.accumulate(np.where(shared < d, at, -1))  # where the label's node of this depth begins
                head = np.where(begins >= 0, rep[begins], path[d])
                first[shared == d] = head[shared == d]
                path[d] = head[-1]
            last = (int(tree[-1]), int(label[-1]), int(rep[-1]))
            tied = (shared >= floor) & (first != rep)
            none = pa.nulls(int(tied.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(first[tied]), pa.array(shared[tied].astype(np.int64)), none, none, none], names)
        if last is not None:
            ends.append((last[2], -2, last[0], last[1]))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) if x is not None else pa.nulls(1, pa.int64()) for x in (ends[0][0], None, -1, part, *ends[0][2:])], names)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) if x is not None else pa.nulls(1, pa.int64()) for x in (ends[1][0], None, -2, part, *ends[1][2:])], names)

    return walk


def ties(classes: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """Sets tied to the first of a node whose prefix is as long as either needs: a, b. classes: rep, labels."""
    spark, floor = classes.sparkSession, floor_depth(threshold, trees, recall)
    labels = classes.select("rep", F.posexplode("labels").alias("tree", "label")).select(F.col("tree").cast("long").alias("tree"), "label", "rep")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * trees // LABEL_ROWS))
    ordered = labels.repartitionByRange(tasks, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    walked = checkpoint(ordered.mapInArrow(_walked(floor), "a long, b long, depth long, part long, tree long, label long"))
    # two rows a task: where one task's labels end and the next one's begin
    ends = sorted((r.part, -r.depth, r.tree, r.label, r.a) for r in walked.filter("depth < 0").collect())
    seams = []
    for (_, kind, tree, label, rep), (_, _, tree2, label2, rep2) in zip(ends, ends[1:], strict=False):
        shared = int(_prefix(np.array([label2]), np.array([label]))[0])
        if kind == 2 and tree == tree2 and shared >= floor and rep != rep2:
            seams.append({"a": rep2, "b": rep, "depth": shared})
    near = walked.filter("depth > 0").select("a", "b", "depth").unionByName(table_of(spark, seams, "a long, b long, depth long"))
    pairs = checkpoint(near.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("met"), F.max("depth").alias("depth")))
    # in how many trees two sets meet at the floor tells their similarity, and that the share found at longer prefixes
    depths = range(floor, MAX_DEPTH + 1)
    likely = [(min(1.0, m / trees)) ** (1 / floor) for m in range(trees + 1)]
    share = {d: F.get(F.array(*[F.lit(found_share(s, d, trees)) for s in likely]), F.least("met", F.lit(trees)).cast("int")) for d in depths}
    similar = F.get(F.array(*[F.lit(s >= threshold) for s in likely]), F.least("met", F.lit(trees)).cast("int"))
    sides = [pairs.filter(similar).select(F.col(x).alias("rep"), *[share[d].alias(f"s{d}") for d in depths]) for x in ("a", "b")]
    means = sides[0].unionByName(sides[1]).groupBy("rep").agg(*[F.avg(f"s{d}").alias(f"s{d}") for d in depths])
    needs = means.select("rep", F.greatest(F.lit(floor), *[F.when(F.col(f"s{d}") >= recall, d).otherwise(floor) for d in depths]).alias("need")).filter(F.col("need") > floor)
    needs = checkpoint(needs)
    few = small(needs, needs.count())
    for x in ("a", "b"):
        pairs = pairs.join(few.withColumnsRenamed({"rep": x, "need": f"need_{x}"}), x, "left")
    enough = F.least(F.coalesce("need_a", F.lit(floor)), F.coalesce("need_b", F.lit(floor)))
    return pairs.filter(F.col("depth") >= enough).select("a", "b")


def _common(owners: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets have in common."""
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(values)])))
    counts = np.zeros((n, n), np.float32)
    run = np.repeat(np.arange(len(heads)), sizes)
    few = sizes[run] <= 8
    o, r = owners[few], run[few]
    for d in range(1, 8):
        same = np.flatnonzero(r[d:] == r[:-d])
        if not len(same):
            break
        counts += np.bincount(o[same] * n + o[same + d], minlength=n * n).reshape(n, n)
    counts += counts.T
    many = np.flatnonzero(sizes > 8)
    for i in range(0, len(many), 4096):
        some = many[i : i + 4096]
        place = np.full(len(heads), -1)
        place[some] = np.arange(len(some))
        mine = place[run] >= 0
        held = np.zeros((n, len(some)), np.float32)
        held[owners[mine], place[run[mine]]] = 1
        counts += held @ held.T
    return counts


def _linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one block, or between two."""
    pdf = pdf.drop_duplicates(["rep", "shingles"])
    sets = [np.frombuffer(s, U) for s in pdf["shingles"]]
    reps, block = pdf["rep"].to_numpy(), pdf["block"].to_numpy()
    sizes, n = np.array([len(s) for s in sets]), len(sets)
    common = _common(np.repeat(np.arange(n), sizes), np.concatenate(sets), n)
    either = sizes[:, None] + sizes[None, :] - common
    near = common / either >= threshold
    if pdf["low"].iloc[0] == pdf["high"].iloc[0]:
        np.fill_diagonal(near, False)
    else:
        near &= block[:, None] != block[None, :]
    links = near.sum(axis=1)
    root = reps.copy()
    while True:
        least = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pd.DataFrame({"rep": reps[some], "links": links[some].astype(np.int64), "root": root[some], "split": bool(pdf["split"].iloc[0])})


def joined(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id (the least id of all that links reach), n_links (other sets this similar), copy_id (the
    least id of an equal set), n_copies, text_key."""
    bounded_batches(docs.sparkSession)
    signed = checkpoint(signatures(docs, width, trees))
    held = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = checkpoint(held.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min("n").alias("n"), F.first("labels").alias("labels")))
    # one id with several texts ties their classes
    several = held.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("doc_id")
    again = None
    if not several.isEmpty():
        shared = held.join(several, "doc_id").select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        least = shared.groupBy("doc_id").agg(F.min("rep").alias("b"))
        again = checkpoint(shared.join(least, "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct())
    tied = ties(classes, threshold, trees, recall)
    near = components(tied if again is None else tied.unionByName(again)).withColumnRenamed("node", "rep")
    weights = classes.select("rep", "n")
    members = checkpoint(near.join(weights, "rep").groupBy("rep").agg(F.max("root").alias("root"), F.max("n").alias("n")))
    parts = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    blocked = salted_join(members, parts, "root", "rep").select("rep", "root", "blocks", F.pmod(F.xxhash64("rep"), "blocks").alias("block"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [s.tobytes() for sets, _ in _sets(batch.column("text"), width) for s in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("rep", "root", "blocks", "block")), pa.array(out, pa.binary())], ["rep", "root", "blocks", "block", "shingles"])

    chosen = docs.select("doc_id", "text").join(small(blocked, members.count()), F.col("doc_id") == F.col("rep")).select("rep", "root", "blocks", "block", "text")
    sets = chosen.mapInArrow(take, "rep long, root long, blocks long, block long, shingles binary").filter(F.length("shingles") > 0)
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "block", (F.col("blocks") > 1).alias("split"), "shingles")
    links = checkpoint(tasks.groupBy("root", "low", "high").applyInPandas(lambda pdf: _linked(pdf, threshold), "rep long, links long, root long, split boolean"))
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    # what one task saw whole is final; forests of several tasks, or tied by an id, are joined
    groups, open_ = links.select("rep", "root"), links
    if again is None:
        groups, open_ = links.filter(~F.col("split")).select("rep", "root"), links.filter("split")
    if again is not None or not open_.isEmpty():
        edges = open_.select(F.col("rep").alias("a"), F.col("root").alias("b"))
        joint = components(edges if again is None else edges.unionByName(again)).select(F.col("node").alias("rep"), "root")
        groups = joint if again is not None else groups.unionByName(joint)
    found = classes.select("h1", "h2", "rep", "n_copies").join(counts, "rep", "left").join(groups, "rep", "left")
    found = found.select("h1", "h2", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("rep").alias("copy_id"), "n_copies")
    rows = held.select("doc_id", "text_key", "h1", "h2").join(found, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "text_key")
    alone = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), "text_key")
    return rows.unionByName(alone)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one of least id (of its rows one), with all columns; wordless ones and those without id stay."""
    found = checkpoint(joined(docs, threshold))
    names = docs.columns
    own, nth = (f"_{k}_{uuid.uuid4().hex}" for k in ("id", "nth"))  # like no column of the documents
    dropped = found.filter("doc_id <> class_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(small(dropped, found.count()), docs["doc_id"] == F.col(own), "left_anti")
    again = found.filter("doc_id = class_id AND n_copies > 1").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return kept
    marked = kept.join(again.select(F.col("doc_id").alias(own)), kept["doc_id"] == F.col(own), "left")
    numbered = marked.withColumn(nth, F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return numbered.filter(F.col(own).isNull() | (F.col(nth) == 1)).select(*names)


def op2_near_join(spark, sf_dir: str) -> DataFrame:
    """One row per document: its class, the number of its links and its copies."""
    return joined(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("text_key")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, least(a, min(b)) AS root FROM r GROUP BY a),
n AS (SELECT a AS rep, count(*) AS n_links FROM l GROUP BY a)
SELECT g.doc_id, coalesce(k.root, c.rep, g.doc_id) AS class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.rep, g.doc_id) AS copy_id, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies
FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN k ON c.rep = k.rep LEFT JOIN n ON c.rep = n.rep
"""
