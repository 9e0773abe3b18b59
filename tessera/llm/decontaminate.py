"""Benchmark decontamination as a prefix-filtered set join, in native DataFrame operations.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A
window's shingles are its runs of three words (fewer in shorter windows), ordered by their frequency in the
documents, which is counted over all of them. As exact containment is asked for, one shingle is a sufficient prefix:
the rarest. A window whose rarest shingle occurs nowhere cannot occur and leaves the join. The documents' shingles
are joined with these prefixes by hash; the length and positional bounds and then the window's words themselves are
compared in the join's condition, so only true occurrences leave it and a document's words are never shuffled. Prefixes
are broadcast in parts of at most `BROADCAST_ROWS` rows and about `BROADCAST_BYTES` bytes, with one reading of the
documents for each; they name their windows by number, and the items of a window join the occurrences afterwards.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; an empty
benchmark leaves every document clean; repeated rows are each returned; rows that share doc_id but not text are told
apart by a hash of the text; items that share a window all count. Null item_ids are not listed. Other columns of
either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._cluster import BROADCAST_ROWS, checkpoint, salted_join, small
from tessera.plans.views import spread

WINDOW = 10
SHINGLE = 3
#: Bytes of one broadcast part.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The key of the row that each document adds after its words, and which the prefixes always hold.
_CLOSING = 0


def pieces(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, and an empty string at an end where a separator stands."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN, -1)


def _ends(parts: Column) -> tuple[Column, Column]:
    """How many empty strings stand at the beginning and at the end."""
    head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    return head, F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)


def _key(parts: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(parts, at + k) for k in range(width)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows: id (a number), window (its words), length, items (sorted ids)."""
    cut = benchmark.select("item_id", F.array_remove(pieces(F.col("text")), "").alias("words")).filter(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))))
    found = (
        cut.select("item_id", "words", at.alias("at"))
        .select("item_id", F.slice("words", F.col("at") + 1, window).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return checkpoint(found.select(F.monotonically_increasing_id().alias("id"), "window", F.size("window").alias("length"), "items"))


def _shingled(found: DataFrame) -> DataFrame:
    """A row for each shingle of each window: id, key, width, ahead (its place in the window)."""
    width = F.least(F.col("length"), F.lit(SHINGLE))
    keys = F.coalesce(*[F.when(width == w, _key(F.col("window"), F.col("ahead"), w)) for w in range(1, SHINGLE + 1)])
    return (
        found.withColumn("width", width)
        .withColumn("ahead", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))))
        .withColumn("key", keys)
    )


def _places(documents: DataFrame, width: int, closing: bool) -> DataFrame:
    """A row for each piece of each document with the key of the shingle that begins there; never materialised.

    Empty pieces stay, as dropping them costs more than all else: no window holds one, so none matches.
    """
    rows = documents.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), pieces(F.col("text")).alias("words"))
    each = F.concat("words", F.array(F.lit(None).cast("string"))) if closing else F.col("words")
    rows = rows.select("doc_id", "text_key", "words", F.posexplode(each).alias("at", "word"))
    key = _key(F.col("words"), F.col("at"), width)
    if closing:
        key = F.when(F.col("word").isNull(), F.lit(_CLOSING).cast("long")).otherwise(key)
    return rows.withColumn("key", key)


def _parts(table: DataFrame, size: tuple[int, int]) -> list[DataFrame]:
    """The table in as many parts as broadcasts need for so many rows and bytes; the documents are read once for each."""
    parts = max(1, -(-size[0] // BROADCAST_ROWS), -(-size[1] // BROADCAST_BYTES))
    return [table.filter(F.pmod("key", F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [table]


def _size(table: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of the windows' words with 64 more for each row and 16 for each word."""
    words = F.aggregate("window", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(words + 64), F.lit(0))).first()
    return rows, size


def occurrences(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Every occurrence of a window: doc_id, text_key, n_words, start, stop, id; start is null in each row's closing line. found: windows()."""
    shingled = checkpoint(_shingled(found.select("id", "window", "length")))
    widths = sorted(r[0] for r in shingled.select("width").distinct().collect())  # 1 to SHINGLE
    total = (shingled.count(), 0)  # a key is a number
    counted = []
    for w in widths:
        keys = shingled.filter(F.col("width") == w).select("key").distinct()
        for part in _parts(keys, total):
            counted.append(_places(documents, w, False).select("key").join(F.broadcast(part), "key", "left_semi").groupBy("key").agg(F.count("*").alias("seen")).withColumn("width", F.lit(w)))
    lines = []
    closing = documents.sparkSession.range(1).select(
        F.lit(_CLOSING).cast("long").alias("key"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("ahead"), F.lit(None).cast("long").alias("id")
    )
    if counted:
        seen = reduce(DataFrame.unionByName, counted)
        rarest = (
            shingled.join(seen, ["key", "width"], "left")
            .groupBy("id", "width")
            .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "ahead")).alias("first"))
            .filter(F.col("first.seen") > 0)
        )
        prefixes = checkpoint(rarest.select("id", "width", "first.key", "first.ahead").join(found.select("id", "window", "length"), "id"))
        size = _size(prefixes)
    else:
        widths, prefixes, size = [SHINGLE], None, (0, 0)
    first = True
    for w in widths:
        table = closing.filter(F.lit(False)) if prefixes is None else prefixes.filter(F.col("width") == w).select("key", "window", "length", "ahead", "id")
        for part in _parts(table, size):
            near = _places(documents, w, first)
            part = part.unionByName(closing) if first else part
            n, begin = F.size("words"), F.col("at") - F.col("ahead")
            head, tail = _ends(F.col("words"))
            inside = (begin >= 0) & (begin + F.col("length") <= n)
            same = F.slice("words", F.when(begin >= 0, begin + 1).otherwise(1), F.coalesce("length", F.lit(0))) == F.col("window")
            # named apart, so that the condition can stand in the join
            near = near.withColumnRenamed("key", "place_key")
            good = (near["place_key"] == part["key"]) & ((F.col("word").isNull() & F.col("window").isNull()) | (F.col("word").isNotNull() & inside & same))
            lines.append(near.join(F.broadcast(part), good).select("doc_id", "text_key", (n - head - tail).cast("long").alias("n_words"), F.when(F.col("window").isNotNull(), begin).alias("start"), (begin + F.col("length")).alias("stop"), "id"))
            first = False
    return reduce(DataFrame.unionByName, lines)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items (their ids as sorted strings), contaminated."""
    found = windows(benchmark, window)
    span = F.struct("start", "stop")
    by_text = checkpoint(
        occurrences(documents, found)
        .groupBy("doc_id", "text_key")
        .agg(
            F.count_if(F.col("start").isNull()).alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), span))).alias("spans"),
            F.collect_set("id").alias("windows"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
    )["n"]
    hit = by_text.filter(F.size("windows") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.explode("windows").alias("id"))
    listed = salted_join(hit, found.select("id", "items"), "id", "hit_key").select("hit_id", "hit_key", F.explode("items").alias("item"))
    listed = listed.groupBy("hit_id", "hit_key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    rows = by_text.join(listed, by_text["doc_id"].eqNullSafe(listed["hit_id"]) & (by_text["text_key"] == listed["hit_key"]), "left")
    return rows.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")
    ).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their columns. Rows of one doc_id and text stand or fall together."""
    hits = checkpoint(occurrences(documents, windows(benchmark, window)).filter(F.col("start").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    hits = small(hits, hits.count())
    key = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    return documents.join(hits, documents["doc_id"].eqNullSafe(hits["_id"]) & (key == hits["_key"]), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents and benchmark."""
    found = contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, win, len(win) AS n FROM (SELECT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM v),
p AS (SELECT rid, doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT p.rid, p.i, p.n, v.item_id FROM p JOIN (SELECT item_id, n, array_to_string(win, ' ') AS win FROM v) v ON p.win = v.win AND p.n = v.n),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
