"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents stand in one line, permuted by a hash, and the line's words are cut into blocks of
`BLOCK_WORDS`. A source's target in words is drawn as whole passes over its line and then blocks of one more pass in
the order of a permutation, the last one cut to the word, so a source's taken words are its target rounded down. The
draws of all sources are dealt to the output shards by a tree: at each node the left half of the shards gets its
exact share of the remaining draws, split among the sources by a multivariate hypergeometric draw, and the right half
the rest. A leaf's quotas are exact counts per source; the permuted draws of a source are disjoint runs, one for each
shard, and a hash orders the draws inside a shard.

Sources may be any number. They are ranked by a distributed sort, targets come from sums over them, and the tree first
splits the draws among groups of `GROUP_SOURCES` sources and then, in a task for each group, among its sources with
the group's quotas, which is the same distribution. Hypergeometric draws beyond numpy's range come from the same
rejection method in decimals of `DIGITS` digits.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source of its own, after
all others; an empty table gives no rows; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm._cluster import bounded_batches, checkpoint, salted_join, sliced, small
from tessera.operators.ordered import running
from tessera.plans.views import spread

WEIGHTS = (5, 2, 1)
COPIES = 3
BLOCK_WORDS = 1024
SHARDS = 16
SEED = 20
LINE_ROWS = 500
GROUP_SOURCES = 10_000
#: Most sources whose plans are broadcast.
BROADCAST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
_LARGEST_DRAW = 10**9
DIGITS = 60


@cache
def _series() -> list[Decimal]:
    """Coefficients of Stirling's series: Bernoulli numbers over 2k(2k - 1)."""
    numbers = [Decimal(1)]
    with localcontext(Context(prec=2 * DIGITS)):
        for m in range(1, 41):
            numbers.append(-sum(Decimal(math.comb(m + 1, k)) * b for k, b in enumerate(numbers)) / (m + 1))
        return [numbers[2 * k] / (2 * k * (2 * k - 1)) for k in range(1, 21)]


def log_factorial(n: int) -> Decimal:
    """The logarithm of n! to about `DIGITS` digits after the point."""
    with localcontext(Context(prec=2 * DIGITS)):
        if n < 512:
            return Decimal(math.factorial(n)).ln()
        x = Decimal(n + 1)
        two_pi = Decimal("6.283185307179586476925286766559005768394338798750211641949889184615632812572417997256069650684234")
        return (x - Decimal("0.5")) * x.ln() - x + two_pi.ln() / 2 + sum(c / x ** (2 * k + 1) for k, c in enumerate(_series()))


def _large_draw(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among so many draws without return, by the ratio of uniforms over the exact weights."""
    total = good + bad
    if not good or not draws:
        return 0
    if not bad or draws == total:
        return min(good, draws)
    few, many, m = min(good, bad), max(good, bad), min(draws, total - draws)
    with localcontext(Context(prec=2 * DIGITS)):
        share = Decimal(few) / total
        centre = m * share + Decimal("0.5")
        spread = ((total - m) * share * m * (1 - share) / (total - 1) + Decimal("0.5")).sqrt()
        width = spread * 2 * (2 / Decimal(1).exp()).sqrt() + (3 - 2 * (3 / Decimal(1).exp()).sqrt())
        weight = lambda z: log_factorial(z) + log_factorial(few - z) + log_factorial(m - z) + log_factorial(many - m + z)
        top = weight((m + 1) * (few + 1) // (total + 2))
        uniform = lambda: (int.from_bytes(rng.bytes(24), "big") + Decimal("0.5")) / (1 << 192)
        while True:
            x, y = uniform(), uniform()
            z = math.floor(centre + width * (y - Decimal("0.5")) / x)
            if max(0, m - many) <= z <= min(few, m) and 2 * x.ln() <= top - weight(z):
                break
    z = z if good <= bad else m - z  # the few are good, or not
    return z if m == draws else good - z


def _hypergeometric(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """How many of each kind are among so many draws without return."""
    out, rest = [], sum(counts)
    for n in counts:
        others = rest - n
        small_ = rest < _LARGEST_DRAW
        out.append((int(rng.hypergeometric(n, others, draws)) if n and draws else 0) if small_ else _large_draw(rng, n, others, draws))
        draws, rest = draws - out[-1], others
    return out


def split_tree(counts: list[int], shards: int = SHARDS, seed: int = SEED, quotas: list[int] | None = None) -> list[list[int]]:
    """Draws of each source that each shard gets: rows are shards, of so many draws; without quotas of sums that differ by one at most."""
    if quotas is None:
        total = sum(counts)
        quotas = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    if shards == 1:
        return [list(counts)]
    left = shards // 2
    got = _hypergeometric(np.random.default_rng([seed, shards, sum(counts) % 2**32]), counts, sum(quotas[:left]))
    rest = [n - g for n, g in zip(counts, got, strict=True)]
    return split_tree(got, left, 2 * seed, quotas[:left]) + split_tree(rest, shards - left, 2 * seed + 1, quotas[left:])


def _step(n: int, seed: int) -> int:
    """A multiplier that permutes 0 to n - 1."""
    step = max(1, int(n * 0.6180339887) + seed % 7)
    while math.gcd(step, max(1, n)) > 1:
        step += 1
    return step


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def ranked(totals: DataFrame, rows: int) -> DataFrame:
    """Adds rank, from 0 by code point and null last, by a distributed sort. totals: source (each once) and others."""
    order = F.col("source").asc_nulls_last()
    dealt = checkpoint(totals.repartitionByRange(max(1, -(-rows // 100_000)), order).withColumn("_at", F.spark_partition_id()))
    before = running(dealt.groupBy("_at").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], "_at", "_n", "_before")
    nth = F.row_number().over(W.partitionBy("_at").orderBy(order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(before.select("_at", "_before")), "_at").withColumn("rank", F.col("_before") + F.col("_nth") - 1).drop("_at", "_nth", "_before")


def targeted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """Adds target: all words by weight, no more than so many copies of a source, the excess reshared. sources: rank, source_size."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    most = F.col("source_size") * copies
    rest, shared = (int(x or 0) for x in sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum(weight)).first())
    total, closed = rest, 0
    while True:
        share = F.lit(float(rest)) * weight / F.lit(float(max(1, shared)))
        over = share > most
        n, full, open_ = sources.agg(F.count_if(over), F.sum(F.when(over, most.cast("decimal(38,0)"))), F.sum(F.when(~over, weight))).first()
        if n == closed:
            return sources.withColumn("target", F.when(over, most.cast("double")).otherwise(share))
        closed, rest, shared = n, total - int(full), int(open_ or 0)


def _draws(target: float, size: int, block: int) -> tuple[int, ...]:
    """Whole passes, full blocks, blocks, whole blocks of the last pass, words of a last block, and all draws."""
    passes, part = divmod(int(target), size) if size else (0, 0)
    full, tail = divmod(size, block)
    blocks, (cut, extra) = full + (tail > 0), divmod(part, block)
    return passes, full, blocks, cut, extra, passes * blocks + cut + (extra > 0)


def plan(totals: DataFrame, n: int, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per source, its target and how it is drawn. totals: source (each once), source_size; n: how many."""
    kind = totals.schema["source"].dataType.simpleString()
    grouped = targeted(checkpoint(ranked(totals, n))).withColumn("group", F.floor(F.col("rank") / GROUP_SOURCES))
    size, part = F.col("source_size"), F.floor("target") % F.greatest(F.col("source_size"), F.lit(1))
    draws = F.when(size > 0, F.floor(F.floor("target") / size) * F.ceil(size / block) + F.ceil(part / block)).otherwise(0)
    sums = sorted((r[0], int(r[1])) for r in grouped.groupBy("group").agg(F.sum(draws.cast("decimal(38,0)"))).collect())  # a number for each GROUP_SOURCES sources
    quotas = dict(zip([g for g, _ in sums], map(list, zip(*split_tree([x for _, x in sums], shards, seed), strict=True)), strict=True)) if sums else {}

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        group = int(rows["group"].iloc[0])
        lines = [_draws(t, int(s), block) for t, s in zip(rows["target"], rows["source_size"], strict=True)]
        leaves = split_tree([x[-1] for x in lines], shards, seed + group + 1, quotas[group])
        ends = np.cumsum(np.array(leaves, np.int64).reshape(shards, len(lines)), axis=0)
        marks = [zlib.crc32(f"{group}:{rank}".encode()) for rank in rows["rank"]]
        out = rows[["source", "source_size", "target"]].assign(_sid=rows["rank"])
        for k, name in enumerate(("_passes", "_full", "_blocks", "_cut", "_extra")):
            out[name] = [x[k] for x in lines]
        out["_step"] = [_step(x[1], m) for x, m in zip(lines, marks, strict=True)]
        out["_begin"] = [m % max(1, x[1]) for x, m in zip(lines, marks, strict=True)]
        out["_ends"] = list(ends.T)
        return out

    schema = f"source {kind}, source_size long, target double, _sid long, _passes long, _full long, _blocks long, _cut long, _extra long, _step long, _begin long, _ends array<long>"
    return checkpoint(grouped.groupBy("group").applyInPandas(planned, schema))


def _line(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Rows with what places them in their source's line."""
    return docs.select(*keep, F.col("source").alias("_source"), words(F.col("text")).alias("_size"), F.xxhash64("doc_id", "text").alias("_key"), F.col("doc_id").alias("_id"))


def _drawn(rows: DataFrame, narrow: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    """Adds to the rows of _line() their source_size, target and draws. narrow: the same rows, cheaper to read.

    The rows are shuffled once, by source and bin, and numbered inside their bin; a bin of a source holds about
    `LINE_ROWS` rows whatever the source's size.
    """
    totals = checkpoint(narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows")))
    n_rows, n_sources = (int(x or 0) for x in totals.agg(F.sum("rows"), F.count("*")).first())
    by = plan(totals.drop("rows"), n_sources, shards, block, seed)
    bins = max(1, -(-n_rows // LINE_ROWS))
    marked = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    by = by.select(marked("source").alias("_mark"), *[c for c in by.columns if c != "source"])

    def binned(df: DataFrame) -> DataFrame:
        df = df.withColumn("_mark", marked("_source"))
        df = df.join(F.broadcast(by), "_mark") if n_sources <= BROADCAST_SOURCES else salted_join(df, by, "_mark", "_key")
        return df.withColumn("_bin", F.pmod("_key", F.lit(bins)))

    sums = checkpoint(binned(narrow).groupBy("_sid", "_bin").agg(F.sum("_size").alias("_n")))
    offsets = running(sums, ["_sid"], "_bin", "_n", "_before").drop("_n")
    within = F.coalesce(F.sum("_size").over(W.partitionBy("_sid", "_bin").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = binned(rows).withColumn("_within", within).join(small(offsets, n_sources * bins), ["_sid", "_bin"]).withColumn("_at", F.col("_before") + F.col("_within"))
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  the product may be beyond 64 bits
    rank = lambda b: F.when(b < F.col("_full"), F.pmod(wide(b) * wide(F.col("_step")) + wide(F.col("_begin")), wide(F.greatest(F.col("_full"), F.lit(1)))).cast("long")).otherwise(F.col("_full"))
    begin = lambda b: F.greatest(b * block - F.col("_at"), F.lit(0))
    end = lambda b: F.least((b + 1) * block - F.col("_at"), F.col("_size"))
    last = lambda b, p: F.when((p < F.col("_passes")) | (rank(b) < F.col("_cut")), end(b)).when(rank(b) == F.col("_cut"), F.least(end(b), b * block + F.col("_extra") - F.col("_at"))).otherwise(begin(b))
    blocks = F.when(F.col("_size") > 0, F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))).otherwise(F.array().cast("array<long>"))

    def drawn(b: Column, p: Column) -> Column:
        draw = p * F.col("_blocks") + rank(b)
        return F.struct(
            p.cast("int").alias("pass"), F.size(F.filter("_ends", lambda e: e <= draw)).alias("shard"), F.xxhash64(draw, F.lit(seed), F.col("_sid")).alias("place"), begin(b).alias("start"), last(b, p).alias("stop")
        )

    passes = F.sequence(F.lit(0).cast("long"), F.col("_passes"))
    each = F.flatten(F.transform(passes, lambda p: F.transform(blocks, lambda b: drawn(b, p))))
    return rows.withColumn("_draws", F.filter(each, lambda x: x["stop"] > x["start"]))


def mixture(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, draws (pass, shard, place, first word, word after the last)."""
    rows = checkpoint(_line(docs, []))
    found = _drawn(rows, rows, shards, block, seed)
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_draws").alias("draws"))


def _taken(draws: Column) -> Column:
    return F.aggregate(draws, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


_word = re.compile(_WORD)


def cut_text(text: str, at: list[tuple[int, int]], spans: list[tuple[int, int]]) -> str:
    """The words of a text from first to before last of each span, with what stands between them. at: where each word is."""
    if spans == [(0, len(at))]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in spans)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a == out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def mixed(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each shard and pass that take words of a document, its text cut to these words.

    Rows of a shard are dealt over tasks by their place, and inside a task stand by shard and place. Other columns stay
    as they are, but n_chars, where there is one, follows the text.
    """
    bounded_batches(docs.sparkSession)
    own = [F.col(n).alias(f"c{i}") for i, n in enumerate(docs.columns)]
    found = _drawn(_line(docs, own), checkpoint(_line(docs, [])), shards, block, seed)
    spans = F.transform("_draws", lambda d: F.struct(d["pass"], d["shard"], d["place"], d["start"], d["stop"]))
    mark = uuid.uuid4().hex  # like no column of the documents
    spans_, shard_, place_ = (f"_{n}_{mark}" for n in ("spans", "shard", "place"))
    rows = found.filter(F.size("_draws") > 0).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)], spans.alias(spans_))
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, at, where = [], [], []
            for i, (text, draws) in enumerate(zip(batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                taken: dict[tuple[int, int], list[dict]] = {}
                for d in draws:
                    taken.setdefault((d["pass"], d["shard"]), []).append(d)
                whole = text.as_py()
                words_at = [m.span() for m in _word.finditer(whole)]
                for (_, shard), of in sorted(taken.items()):
                    texts.append(cut_text(whole, words_at, _joined([(d["start"], d["stop"]) for d in of])))
                    at.append(i)
                    where.append((shard, min(d["place"] for d in of)))
            columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], batch.schema.field(chars_at).type)
            columns += [pa.array([x[0] for x in where], pa.int32()), pa.array([x[1] for x in where], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], shard_, place_])

    schema = StructType([*docs.schema.fields, StructField(shard_, IntegerType()), StructField(place_, LongType())])
    cut = rows.mapInArrow(parts, schema)
    return cut.repartition(F.col(shard_), F.shiftright(place_, 48)).sortWithinPartitions(shard_, place_).drop(shard_, place_)


def _dealt(draws: Column) -> Column:
    """The draws as shard:place:pass:start:stop, by shard and by place in it."""
    ordered = F.array_sort(F.transform(draws, lambda x: F.struct(x["shard"], x["place"], x["pass"], x["start"], x["stop"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in ("shard", "place", "pass", "start", "stop")])), ",")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents, and where each draw of a document stands in the mix."""
    found = mixture(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "size", "source_size", "target", _taken(F.col("draws")).alias("taken"), _dealt(F.col("draws")).alias("dealt"))
