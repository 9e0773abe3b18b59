"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built and cut into parts of equal size, half by half: each half is found
along the graph's slowest mode of smoothing and then improved by exchanging vertices. A small network with one hidden
layer learns in which parts a vector's neighbours, itself among them, are found. It puts every indexed row into its most
probable part and sends every query to the most probable parts, until their probability reaches a level; the level is
the least at which queries kept out of the fit find `TARGET` of their neighbours in the sample. Candidates of those
parts, and no others, are ranked by the exact inner product in double precision.

One network has at most `FAN` parts. Parts of more than `SPLIT_ROWS` rows get a sample, a graph and a network of their
own, in a task, and are divided by it in turn, so the parts grow in number with the rows and not in size. Each fit uses
about `SAMPLE_ROWS` rows and `SAMPLE_QUERIES` more for the level, chosen by a hash of the id; of several networks in
turn each has to find the root of `TARGET`.

Equal vectors score alike, and ties go to the smaller id, so of equal vectors the `nearest` + 1 of least id are all
that any query can be answered with (one may be the query's own); only these are indexed, which loses no answer, and
equal queries are searched once. What is still large in a part meets in blocks of rows and of queries.

Defined results: vectors null, zero, holding null or non-finite components, of another length than most, or without an
id take no part; rows of one vec_id count as one, with the score of the nearest, and never answer their own query; a
query with fewer candidates gets them all, and one whose parts hold too few is sent on until they hold enough; an empty
table or a single vector gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._cluster import bounded_batches, checkpoint, salted_join, small

SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 512
NEIGHBOURS = 16
HIDDEN = 96
TARGET = 0.95
NEAREST = 20
QUERY_EVERY = 20
ROWS_PER_PART = 1500
FAN = 64
SPLIT_ROWS = 2 * FAN * ROWS_PER_PART
#: Rows that one task places by one network.
SLICE_ROWS = 16_384
BESIDE = 8
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 1024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("embedding") == (sizes[0] if sizes else 0))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest of each row by inner product, without itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        out[i : i + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halves(graph: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Which vertices are in the second of two equal halves. graph: neighbours by vertex, -1 where outside."""
    n = len(graph)
    inside = graph >= 0
    at = np.where(inside, graph, 0)
    degree = np.maximum(1, inside.sum(axis=1) + np.bincount(at[inside], minlength=n))

    def around(v: np.ndarray) -> np.ndarray:
        return (np.where(inside, v[at], 0).sum(axis=1) + np.bincount(at[inside], np.repeat(v, inside.sum(axis=1)), n)) / degree

    v = rng.normal(size=n)
    for _ in range(60):
        v = v + around(v)
        v -= np.average(v, weights=degree)
        v /= max(1e-12, np.abs(v).max())
    second = np.zeros(n, bool)
    second[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(rounds):
        pull = around(np.where(second, 1.0, -1.0)) * np.where(second, -1.0, 1.0) * degree  # what moving gains
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = a[np.argsort(-pull[a], kind="stable")], b[np.argsort(-pull[b], kind="stable")]
        m = min(len(a), len(b))
        swap = np.flatnonzero(pull[a[:m]] + pull[b[:m]] > 0)[: max(1, n // 40)]
        if not len(swap):
            break
        second[a[swap]], second[b[swap]] = True, False
    return second


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each vertex; parts is a power of two."""
    out = np.zeros(len(graph), np.int64)
    rng = np.random.default_rng(seed)
    todo = [(np.arange(len(graph)), parts, 0)]
    while todo:
        rows, p, first = todo.pop()
        if p == 1 or len(rows) < 2:
            out[rows] = first
            continue
        place = np.full(len(graph), -1)
        place[rows] = np.arange(len(rows))
        second = _halves(place[graph[rows]], rng)
        todo += [(rows[~second], p // 2, first), (rows[second], p // 2, first + p // 2)]
    return out


@dataclass
class Router:
    """The network, and the level of probability that queries are sent to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    level: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, wanted: np.ndarray, steps: int = 400, seed: int = 3) -> Router:
    """Cross-entropy by Adam on batches. wanted: for each row of x the share of its neighbours in each part."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], wanted.shape[1]
    scale = np.sqrt(2.0)
    w = [rng.normal(size=(d, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    unit = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), min(len(x), 512))
        a, y = unit[some], wanted[some]
        h = np.maximum(0, a @ w[0] + w[1])
        z = h @ w[2] + w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p = (p - y) / len(y)
        back = (p @ w[2].T) * (h > 0)
        grads = [a.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0)]
        rate = 0.01 * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def fit(x: np.ndarray, queries: np.ndarray, parts: int, target: float = TARGET, nearest: int = NEAREST) -> Router:
    """Learns parts from a sample and the level from queries outside it."""
    if len(x) < 2 or parts == 1:
        return Router(np.zeros((x.shape[1] if x.ndim == 2 else 1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x)
    part = balanced_parts(graph, parts)
    wanted = np.zeros((len(x), parts))
    for near in (np.arange(len(x))[:, None], graph):
        np.add.at(wanted, (np.arange(len(x))[:, None], part[near]), 1.0)
    router = train_router(x, wanted / wanted.sum(axis=1, keepdims=True))
    for _ in range(30):  # the parts of the most probable choice are made as large as each other
        share = np.bincount(router.logits(x).argmax(axis=1), minlength=parts) / len(x)
        router.b2 = router.b2 - 0.3 * np.log((share + 0.1 / parts) * parts / 1.1)
    if not len(queries):
        return router
    home = router.logits(x).argmax(axis=1)
    k = min(nearest, len(x))
    near = np.argsort(-(queries @ x.T), axis=1)[:, :k]
    p = router.probabilities(queries)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    need = np.empty_like(p)  # a part is visited if the level is above this
    np.put_along_axis(need, order, before, axis=1)
    needs = np.sort(np.take_along_axis(need, home[near], axis=1).ravel())
    router.level = float(min(1.0, needs[min(len(needs) - 1, int(np.ceil(target * len(needs))))] + 1e-9))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _best(q: np.ndarray, ask: np.ndarray, c: np.ndarray, cid: np.ndarray, most: int) -> list[np.ndarray]:
    """Asks, row ids and scores of the nearest rows, ties to the smaller id; an id counts once, by its best row."""
    found: list[list[np.ndarray]] = [[], [], []]
    order = np.argsort(cid, kind="stable")
    c, cid = c[order], cid[order]
    first = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1]))) if len(cid) else np.zeros(0, np.int64)
    for i in range(0, len(q) if len(c) else 0, 256):
        score = q[i : i + 256] @ c.T
        by_id = score if len(first) == len(cid) else np.maximum.reduceat(score, first, axis=1)
        k = min(most, len(first))
        least = np.partition(by_id, len(first) - k, axis=1)[:, len(first) - k]
        # rounding differs by place in a block: near ties come along and are scored anew, each in the same way
        row, col = np.nonzero(score >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
        exact = np.einsum("ij,ij->i", q[i + row], c[col])
        order = np.lexsort((-exact, cid[col], row))
        row, col, exact = row[order], col[order], exact[order]
        once = np.concatenate(([True], (row[1:] != row[:-1]) | (cid[col[1:]] != cid[col[:-1]])))
        row, col, exact = row[once], col[once], exact[once]
        order = np.lexsort((cid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        keep = np.arange(len(row)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(row)])))) < most
        for out, values in zip(found, (ask[i + row[keep]], cid[col[keep]], exact[keep]), strict=True):
            out.append(values)
    return [np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]


def _ranked(table: pa.Table, most: int) -> pa.Table:
    """The nearest rows of some parts for each query of a block, of those parts that it is sent to."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
    x = _matrix(table.column("embedding").combine_chunks())
    found = [_best(x[q], ids[q], x[c], ids[c], most) for p in np.unique(part[asks]) for q, c in ((asks & (part == p), ~asks & (part == p)),)]
    ask, vec_id, score = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((-score, vec_id, ask))  # an id may be in several parts
    ask, vec_id, score = ask[order], vec_id[order], score[order]
    once = np.ones(len(ask), bool)
    once[1:] = (ask[1:] != ask[:-1]) | (vec_id[1:] != vec_id[:-1])
    ask, vec_id, score = ask[once], vec_id[once], score[once]
    order = np.lexsort((vec_id, -score, ask))
    ask, vec_id, score = ask[order], vec_id[order], score[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ask)), bool), ask[1:] != ask[:-1])))
    keep = np.arange(len(ask)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(ask)])))) < most
    return pa.table([ask[keep], vec_id[keep], score[keep]], names=["ask", "vec_id", "score"])


def parts_for(rows: int) -> int:
    """How many parts one network divides so many rows into; a power of two."""
    return 2 ** int(np.clip(np.round(np.log2(max(1, rows) / ROWS_PER_PART)), 2, np.log2(FAN)))


def _trained(nearest: int, target: float, parts: int | None) -> Callable[[pa.Table], pa.Table]:
    """Makes the network of a part from its sample."""

    def train(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("id", "ascending"), ("nth", "ascending")])
        x = _matrix(sample.column("embedding").combine_chunks())
        # a hash dealt the rows, so any of them can be the queries; ids that are close may be related
        mixed = np.random.default_rng(5).permutation(len(x))
        apart = min(SAMPLE_QUERIES, len(x) // 5)
        router = fit(x[mixed[apart:]], x[mixed[:apart]], parts or parts_for(sample.column("n")[0].as_py()), target, nearest)
        return pa.table({"part": sample.column("part").slice(0, 1), "model": pa.array([pickle.dumps(astuple(router))], pa.binary())})

    return train


def _placed(rows: pa.Table, models: pa.Table) -> pa.Table:
    """The rows with the part inside their part that is most probable."""
    if rows.num_rows and models.num_rows:
        router = Router(*pickle.loads(models.column("model")[0].as_py()))
        child = router.logits(_matrix(rows.column("embedding").combine_chunks())).argmax(axis=1)
        part = rows.column("part").to_numpy() * (FAN + 1) + child + 1
    else:
        rows, part = rows.slice(0, 0), np.zeros(0, np.int64)
    return pa.table({"id": rows.column("id"), "embedding": rows.column("embedding"), "part": pa.array(part)})


def _sent(enough: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The queries with each part inside their part that they are sent to."""

    def send(asks: pa.Table, models: pa.Table) -> pa.Table:
        if not asks.num_rows or not models.num_rows:
            return pa.table({"id": asks.column("id").slice(0, 0), "embedding": asks.column("embedding").slice(0, 0), "part": pa.array([], pa.int64())})
        router = Router(*pickle.loads(models.column("model")[0].as_py()))
        p = router.probabilities(_matrix(asks.column("embedding").combine_chunks()))
        sizes, above = np.zeros(p.shape[1], np.int64), int(asks.column("part")[0].as_py()) * (FAN + 1) + 1
        for held in models.column("sizes")[0].as_py():
            sizes[held["part"] - above] = held["ids"]
        order = np.argsort(-p, axis=1, kind="stable")
        ranked, held = np.take_along_axis(p, order, axis=1), sizes[order]
        go = (np.cumsum(ranked, axis=1) - ranked < router.level) | (np.cumsum(held, axis=1) - held < enough)
        row, at = np.nonzero(go)
        return pa.table({"id": asks.column("id").take(pa.array(row)), "embedding": asks.column("embedding").take(pa.array(row)), "part": pa.array(above + order[row, at])})

    return send


def _dealt(rows: DataFrame, models: DataFrame, tell: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Applies the network of each part to its rows, some at a time. Both have n, the part's rows."""
    slices = F.greatest(F.ceil(F.col("n") / SLICE_ROWS), F.lit(1))
    mine = rows.withColumn("slice", F.pmod(F.xxhash64("id", F.lit("slice")), slices)).drop("n")
    copies = models.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("n")
    return mine.groupBy("part", "slice").cogroup(copies.groupBy("part", "slice")).applyInArrow(tell, "id long, embedding array<double>, part long")


def _counted(rows: DataFrame) -> DataFrame:
    """part and n (rows) of each part, marked for a broadcast if they are few."""
    counts = checkpoint(rows.groupBy("part").agg(F.count("*").alias("n")))
    return small(counts, counts.count())


def indexed(rows: DataFrame, asks: DataFrame, total: int, nearest: int = NEAREST, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (id, embedding) with their part, and the queries once for each part that they are sent to."""
    levels = 1 + max(0, math.ceil(math.log(max(1.0, total / SPLIT_ROWS), FAN)))
    target = TARGET ** (1 / levels)
    placed, sent = (df.withColumn("part", F.lit(0).cast("long")) for df in (rows, asks))
    for level in range(levels + 1 if total > 1 else 0):  # one more for parts that turn out larger
        if not level:  # all rows are one part
            n_asks = asks.count()
            of_rows, of_asks = (lambda df: df.withColumn("n", F.lit(total))), (lambda df: df.withColumn("n", F.lit(n_asks)))
        elif total <= SPLIT_ROWS:
            break
        else:
            large = checkpoint(placed.filter(F.col("part") >= (FAN + 1) ** (level - 1)).groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_ROWS))
            several = large.count()
            if not several:
                break
            large = small(large, several)
            large_asks = _counted(sent.join(large.select("part"), "part", "left_semi"))
            of_rows, of_asks = (lambda df, n=large: df.join(n, "part")), (lambda df, n=large_asks: df.join(n, "part"))
        chosen = of_rows(placed).filter(F.pmod(F.xxhash64("id", F.lit(level)), "n") < SAMPLE_ROWS + SAMPLE_QUERIES)
        models = checkpoint(chosen.withColumn("nth", F.xxhash64("embedding")).groupBy("part").applyInArrow(_trained(nearest, target, parts), "part long, model binary"))
        fresh = checkpoint(_dealt(of_rows(placed), of_rows(models), _placed))
        # an id in several parts counts in the first only, so that the parts sent to surely hold so many
        by_id = fresh.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("ids"))
        sizes = by_id.groupBy(F.floor((F.col("part") - 1) / (FAN + 1)).alias("above")).agg(F.collect_list(F.struct("part", "ids")).alias("sizes")).withColumnRenamed("above", "part")  # at most FAN
        on = checkpoint(_dealt(of_asks(sent), of_asks(models.join(sizes, "part")), _sent(nearest + 1)))
        if level:
            fresh, on = (old.join(large.select("part"), "part", "left_anti").select("id", "embedding", "part").unionByName(new) for old, new in ((placed, fresh), (sent, on)))
        placed, sent = fresh, on
    return placed, sent


def _blocks(placed: DataFrame, sent: DataFrame, most: int) -> DataFrame:
    """ask, vec_id, score: the nearest rows for each query in the parts that it is sent to, of some parts at a time.

    Parts of one network that stand side by side are alike, so `BESIDE` of them meet their queries together and each
    query takes the nearest of them all along.
    """
    part = F.col("part") - 1
    bundle = part - F.pmod(F.pmod(part, F.lit(FAN + 1)), F.lit(BESIDE))
    placed, sent = (df.withColumn("bundle", bundle) for df in (placed, sent))
    rows = checkpoint(placed.groupBy("bundle").agg(F.count("*").alias("n")).join(sent.groupBy("bundle").agg(F.countDistinct("id").alias("q")), "bundle"))
    counts = rows.select("bundle", F.ceil(F.col("n") / BLOCK_ROWS).alias("rows"), F.ceil(F.col("q") / BLOCK_QUERIES).alias("queries"))
    counts = small(counts, rows.count())
    own = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = placed.join(counts, "bundle").select("bundle", own("rows").alias("row_block"), each("queries").alias("query_block"), F.lit(False).alias("asks"), "part", "id", "embedding")
    asks = sent.join(counts, "bundle").select("bundle", each("rows").alias("row_block"), own("queries").alias("query_block"), F.lit(True).alias("asks"), "part", "id", "embedding")
    return held.unionByName(asks).groupBy("bundle", "row_block", "query_block").applyInArrow(lambda t: _ranked(t, most), "ask long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each vector that is a query."""
    bounded_batches(vectors.sparkSession)
    rows = valid(vectors)
    # of equal vectors the first ids are all that can be answers
    nth = F.row_number().over(W.partitionBy("hash", "embedding").orderBy("vec_id"))
    held = checkpoint(rows.distinct().withColumn("hash", F.xxhash64("embedding")).withColumn("nth", nth).filter(F.col("nth") <= nearest + 1).select(F.col("vec_id").alias("id"), "embedding"))
    queries = rows.filter(is_query).distinct()
    questions = checkpoint(queries.select("embedding").distinct().withColumn("id", F.monotonically_increasing_id()))
    placed, sent = indexed(held, questions, held.count(), nearest, parts)
    top = _blocks(placed, sent, nearest + 1)
    order = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    top = top.groupBy("ask", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", order).filter(F.col("rank") <= nearest + 1)
    top = top.groupBy("ask").agg(F.collect_list(F.struct("vec_id", "score")).alias("top"))  # at most nearest + 1
    answered = questions.join(top, F.col("id") == F.col("ask")).select("embedding", "top")
    found = salted_join(queries, answered, "embedding", "vec_id").select(F.col("vec_id").alias("query_id"), F.inline("top")).filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank)
    return found.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: every vector whose id is divisible by 20, against all."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)
