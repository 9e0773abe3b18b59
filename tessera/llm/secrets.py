"""Secret scan with a trigram index, in native DataFrame operations.

From each rule's pattern a Boolean query over lower-cased trigrams is derived: literal runs give trigrams that must
all be there, alternatives give a choice of such sets. One pass over the texts writes the inverted index: for each
trigram that a query names (the `PER_CHOICE` of rarest letters in each choice) the postings of the documents that hold
it. Documents have slots, a hash of id and text over `LOAD` slots a row, and postings are bitmaps of `BITS` slots. A
rule's candidates are its trigrams' postings, intersected within a choice and united over the choices; of documents
that share a slot, all are candidates if one is. Only candidates are searched with the rule's pattern; a rule without
mandatory trigrams is searched in all documents.

A search takes the texts between the matches and the matches themselves, whose lengths in turn give the places, in
code points, by a running sum of as many steps as the number of matches has bits.

Defined results: null and empty texts have no spans; matches of one rule never overlap, of different rules may; spans
are ordered by start and then by the order of `RULES`; repeated rows are each returned; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._cluster import checkpoint, salted_join, table_of
from tessera.plans.views import spread

#: Slots of one bitmap, as Spark's bitmap functions have them, and slots for each row.
BITS, LOAD = 1 << 15, 2
#: Most trigrams of one choice that are indexed.
PER_CHOICE = 3
_COMMON = "etaoinshrdlu "
#: Most bytes of candidates' bitmaps that are broadcast; more are joined by a shuffle.
CANDIDATE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """A pattern both Python and Java read; a match counts if the group has at least so many characters.

    Where another pattern finds just the matches that count, `search` is that pattern.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    search: str | None = None


#: The base kinds first, then public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query is a choice of trigram sets; one empty set admits everything.
Query = frozenset[frozenset[str]]
_ALL: Query = frozenset([frozenset()])
_MOST = 64
_MOST_CHOICES = 8


def _simple(query: Query) -> Query:
    """Without sets that hold another set whole."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    both = _simple(frozenset(x | y for x in a for y in b))
    return both if len(both) <= _MOST else a


def _trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _strings(strings: frozenset[str]) -> Query:
    """What a text must hold to hold one of the strings."""
    return _simple(frozenset(_trigrams(s) for s in strings)) if strings else _ALL


def _walk(tree) -> tuple[frozenset[str] | None, Query]:
    """The strings that a pattern matches, if they are few, and else what a match must hold."""
    done: Query = _ALL
    run: frozenset[str] = frozenset([""])
    exact = True
    for op, arg in tree:
        name = str(op)
        inner: frozenset[str] | None = None
        query = _ALL
        if name == "LITERAL":
            inner = frozenset([chr(arg).lower()])
        elif name == "IN":
            letters = [chr(a).lower() for o, a in arg if str(o) == "LITERAL"]
            if len(letters) == len(arg) and len(set(letters)) <= _MOST_CHOICES:
                inner = frozenset(letters)
        elif name == "SUBPATTERN":
            inner, query = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                inner = frozenset().union(*(s for s, _ in parts))
            else:
                query = _simple(frozenset().union(*(q if s is None else _strings(s) for s, q in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            strings, query = _walk(body)
            if strings is not None and (least, most) == (0, 1):
                inner = strings | {""}
            elif strings is not None and least == most and least <= 4:
                inner = frozenset([""])
                for _ in range(least):
                    inner = frozenset(a + b for a in inner for b in strings)
            query = _ALL if least == 0 else (query if strings is None else _strings(strings))
        if inner is not None and len(run) * len(inner) <= _MOST:
            run = frozenset(a + b for a in run for b in inner)
            continue
        exact = False
        done = _and(done, _strings(run))
        if inner is not None:
            run = inner
        else:
            done, run = _and(done, query), frozenset([""])
    return (run, _strings(run)) if exact else (None, _and(done, _strings(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern."""
    return _walk(re._parser.parse(pattern))[1]


def indexed_query(pattern: str, most: int = PER_CHOICE) -> Query:
    """The query with the trigrams of rarest letters of each choice; fewer conditions admit more texts, never fewer."""
    rarity = lambda t: (sum(c in _COMMON for c in t), t)
    return _simple(frozenset(frozenset(sorted(choice, key=rarity)[:most]) for choice in trigram_query(pattern)))


def named(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that are indexed."""
    return sorted({t for r in rules for choice in indexed_query(r.pattern) for t in choice})


def _slotted(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and the slot: bucket and bit."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets * BITS))
    return rows.withColumn("slot", slot).select("doc_id", "text", F.floor(F.col("slot") / BITS).alias("bucket"), (F.col("slot") % BITS).alias("bit"))


def index(docs: DataFrame, rules: tuple[Rule, ...], buckets: int) -> DataFrame:
    """The inverted index: trigram, bucket, postings (a bitmap of the bucket's slots)."""
    # the lower-cased text is made once for all trigrams
    low = _slotted(docs, buckets).select("bucket", "bit", F.lower("text").alias("low"))
    found = low.select("bucket", "bit", F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in named(rules)])).alias("found"))
    rows = found.select("bucket", "bit", F.explode_outer("found").alias("trigram")).filter("trigram IS NOT NULL")  # explode() would look twice
    return rows.groupBy("trigram", "bucket").agg(F.bitmap_construct_agg("bit").alias("postings"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...], buckets: int) -> DataFrame:
    """A row for each bucket: of each rule that has a trigram query the candidates' bitmap, null if there are none."""
    spark = postings.sparkSession
    wanted = [{"rule": i, "choice": c, "size": len(choice), "trigram": t} for i, r in enumerate(rules) for c, choice in enumerate(sorted(indexed_query(r.pattern), key=sorted)) for t in choice]
    held = spark.range(buckets).withColumnRenamed("id", "bucket")
    if not wanted:
        return held
    of = F.broadcast(table_of(spark, wanted, "rule int, choice int, size int, trigram string"))
    both = postings.join(of, "trigram").groupBy("bucket", "rule", "choice", "size").agg(F.bitmap_and_agg("postings").alias("all"), F.count("*").alias("n")).filter("n = size")
    any_ = both.groupBy("bucket", "rule").agg(F.bitmap_or_agg("all").alias("any")).filter(F.bitmap_count("any") > 0)
    by_rule = any_.groupBy("bucket").agg(*[F.max(F.when(F.col("rule") == i, F.col("any"))).alias(f"c{i}") for i in sorted({w["rule"] for w in wanted})])
    return held.join(by_rule, "bucket", "left")


def _holds(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _running(lengths: Column) -> Column:
    """Sums of all numbers up to each, by doubling steps, so that a long list takes no square of steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int"))
    return F.aggregate(steps, lengths, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def _spans(rule: Rule, order: int) -> Column:
    """Spans of a rule in a text: start, order, stop."""
    pattern = rule.search or rule.pattern
    between, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
    kept = hits if rule.group == 0 else F.regexp_extract_all("text", F.lit(pattern), rule.group)
    lengths = F.transform(F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), kept.alias("kept")), lambda x: F.struct((F.length(x["gap"]) + F.length(x["hit"])).alias("both"), F.length(x["hit"]).alias("hit"), F.length(x["kept"]).alias("kept")))
    # the gaps and matches before a match end where it begins
    placed = F.arrays_zip(lengths.alias("of"), _running(F.transform(lengths, lambda x: x["both"])).alias("stop"))
    good = F.filter(placed, lambda x: x["of"]["kept"] >= rule.least)
    return F.transform(good, lambda x: F.struct((x["stop"] - x["of"]["hit"]).alias("start"), F.lit(order).alias("order"), x["stop"].alias("stop")))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and spans (start, order of the rule, stop), ordered."""
    buckets = max(1, -(-docs.count() * LOAD // BITS))
    chosen = checkpoint(candidates(checkpoint(index(docs, rules, buckets)), rules, buckets))
    rows = _slotted(docs, buckets)
    few = buckets * (len(chosen.columns) - 1) * BITS // 8 <= CANDIDATE_BYTES
    rows = rows.join(F.broadcast(chosen), "bucket") if few else salted_join(rows, chosen, "bucket", "text")
    none = F.array().cast("array<struct<start:int,order:int,stop:int>>")
    for i, rule in enumerate(rules):
        may = _holds(F.col(f"c{i}"), F.col("bit")) if f"c{i}" in chosen.columns else F.col("text").rlike(rule.search or rule.pattern)
        rows = rows.withColumn(f"s{i}", F.when(may, _spans(rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("spans"))


def _text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    found = scanned(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    count = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text(base, RULES), 256).alias("base_sha256"), _text(F.col("spans"), RULES).alias("spans"))


def _kind_sql(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {order} AS o, '{rule.kind}' AS kind, k, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS a, length(hits[k]) AS n FROM (SELECT rid, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT rid, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS kept FROM d)) WHERE length(kept[k]) >= {rule.least}"""


OP5_SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents), s AS ("
    + " UNION ALL ".join(_kind_sql(r, i) for i, r in enumerate(RULES))
    + """), t AS (SELECT rid, o, a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR) AS x FROM s),
g AS (SELECT rid, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, string_agg(x, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(x, ',' ORDER BY a, o) AS spans FROM t GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
)
