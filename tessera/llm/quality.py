"""Quality classifier by compression with zstandard dictionaries.

Of a pair of dictionaries one is trained on labelled good text, one on bad. A text is cut into blocks of `BLOCK` bytes
and each block is compressed with either dictionary; the difference of the summed sizes over their sum (and a constant
that damps very short texts) is what a pair says. There are `PAIRS` pairs, each trained without another part of the
labelled rows, and the mean of what they say is the only feature. A logistic curve makes it a calibrated probability of
a good label; it is fitted on what each pair says of the part that it was trained without.

Fitting uses the whole texts of at most `SAMPLE_ROWS` rows of each class, the only bound, dealt into parts by a hash. The
class shares come from all training labels. Scoring reads every byte of every text.

Defined results: null and empty texts have difference 0 and get the curve's value there; with one class or none among
the labels every score is the share of good labels (0.5 without labels); repeated rows are scored alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._cluster import bounded_batches, checkpoint
from tessera.llm._labelled import SAMPLE_ROWS, fold, logistic, sampled
from tessera.plans.views import spread

BLOCK = 2048
LEVEL = 3
DICTIONARY_BYTES = 1 << 18
DAMP = 64
PAIRS = 3
FOLDS, HELD = 5, 0
THRESHOLD = 0.3


@dataclass
class Model:
    """Pairs of dictionaries for bad and good text, and the curve; without dictionaries the share alone."""

    dictionaries: tuple[tuple[bytes, bytes], ...] | None
    curve: tuple[float, float]
    share: float


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(parts: list[bytes]) -> bytes:
    parts = sorted(parts, key=lambda b: (zlib.crc32(b), b))  # the trainer takes stretches of its input, so each must hold many texts
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[-size:]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Sizes:
    """Compressed sizes with the dictionaries of each pair."""

    def __init__(self, dictionaries: tuple[tuple[bytes, bytes], ...]):
        self.pairs = [(_compressor(bad), _compressor(good)) for bad, good in dictionaries]

    def difference(self, parts: list[bytes]) -> float:
        """Above 0 if the good dictionaries serve better."""
        said = 0.0
        for pair in self.pairs:
            bad, good = (sum(len(c.compress(b)) for b in parts) for c in pair)
            said += (bad - good) / (bad + good + DAMP)
        return said / len(self.pairs)


def difference(dictionaries: tuple[tuple[bytes, bytes], ...]) -> Callable[[Column], Column]:
    """The difference of a column of texts; only the texts go to Python."""

    @F.arrow_udf("double")
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(dictionaries)
        for some in texts:
            yield pa.array(np.fromiter((sizes.difference(blocks(t.as_py() or b"")) for t in some.cast(pa.binary())), float, len(some)))

    return measured


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labels.quality outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    texts, counts = sampled(docs, labels, "quality", folds, held, rows)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total if total else 0.5
    texts = checkpoint(texts.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PAIRS))))
    learn: dict[tuple[int, int], list[bytes]] = {(k, label): [] for k in range(PAIRS) for label in (0, 1)}
    for k, label, text in texts.select("fold", "label", F.col("text").cast("binary")).collect():
        learn[k, label].extend(blocks(bytes(text)))
    parts = [[[b for other in range(PAIRS) if other != k for b in learn[other, label]] for label in (0, 1)] for k in range(PAIRS)]
    if min(sum(map(len, of)) for pair in parts for of in pair) < 1024:
        return Model(None, (0.0, 0.0), share)
    trained = tuple((_dictionary(bad), _dictionary(good)) for bad, good in parts)  # one by one, as training takes memory
    apart = [texts.filter(F.col("fold") == k).select(difference(trained[k : k + 1])("text"), "label") for k in range(PAIRS)]
    check = np.array(sorted(map(tuple, reduce(DataFrame.union, apart).collect())), float).reshape(-1, 2)
    x, y = check[:, 0], check[:, 1]
    if len(set(y)) < 2:
        return Model(None, (0.0, 0.0), share)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    slope, cut = logistic(x, y, weight)
    return Model(trained, (float(slope), float(cut)), share)


def score(text: Column, model: Model) -> Column:
    """The probability of a good label."""
    if not model.dictionaries:
        return F.lit(model.share)
    z = F.lit(model.curve[0]) * difference(model.dictionaries)(text) + F.lit(model.curve[1])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", score(F.col("text"), model).alias("score"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns, which never leave the JVM."""
    bounded_batches(docs.sparkSession)
    return docs.filter(score(docs["text"], model) >= threshold)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
