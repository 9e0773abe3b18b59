import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def docs(spark, rows, extra=False):
    """Documents of (doc_id, text) or (doc_id, text, source) rows, with columns of clashing names if asked."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "shard", "slot", "key", "score", "label", "rep", "root", "draws", "n", "_id", "_key", "words", "taken", "target", "block", "part", "rank"):
            df = df.withColumn(name, F.lit("mine"))
    return df


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "!!! ---"), (5, "one"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (7, "é" * 50_000), (8, "word " * 40_000), (9, "One, TWO three; four five SIX!")]


def prose(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    return " ".join(rng.choice(vocab) for _ in range(n))
