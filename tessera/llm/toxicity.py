"""Toxicity classifier with counterfactual regularisation.

A text's features are the words it holds and the first four and five bytes of its words, hashed into `BUCKETS`; each
counts once. A logistic model is fitted on labelled texts. Of every labelled text that holds identity terms, as whole
words, counterfactual copies are made: one for each of its terms and each other term of that kind and language, which
takes the term's place wherever it stands. The copies' features are those of the changed text, and the loss adds
`PENALTY` times the mean squared change of the score's logit from a text to its copies, so a mention of a group moves
the score as little as the labels allow. A text without identity terms has no copies and adds nothing.

Fitting uses at most `SAMPLE_ROWS` rows of each class; the class shares come from all training labels. A curve fitted
on a quarter of these rows, which the first fit leaves out, calibrates the score; the fit then goes on over all of them.
Scoring reads every word of every text.

Defined results: null, empty and wordless texts have no features and get the score of the intercept; with one class or
none among the labels every score is the share of toxic labels (0 without labels); repeated rows are scored alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._cluster import bounded_batches
from tessera.llm._labelled import SAMPLE_ROWS, fold, logistic, sampled, sigmoid
from tessera.llm._words import U, mix, words
from tessera.plans.views import spread

BUCKETS = 1 << 18
PREFIXES = (4, 5)
PENALTY = 4.0
RIDGE = 1e-4
SHRINK = 10.0
#: Features whose log-odds ratio is nearer to nothing than this are left out of the fit.
LEAST = 0.2
STEPS, AGAIN_STEPS = 200, 60
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Terms that may stand for each other in a neutral mention, in the four languages of the documents. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("blind", "deaf", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("blinde", "gehörlose", "behinderte", "autisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("aveugles", "sourds", "handicapés", "autistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("ciegos", "sordos", "discapacitados", "autistas"),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """Sorted distinct buckets of some texts at a time, their bounds by text, and which texts."""
    for found in words(column):
        sizes = np.diff(found.bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes).astype(U)
        kinds = []
        for salt, length in enumerate((None, *PREFIXES)):
            bucket = mix(found.hashes(length) + U(salt + 1)) % U(BUCKETS)
            kinds.append(owner * U(BUCKETS) + bucket)
        both = np.unique(np.concatenate(kinds))
        yield (both % U(BUCKETS)).astype(np.int64), np.searchsorted(both, np.arange(len(sizes) + 1, dtype=U) * U(BUCKETS)), found.rows


def _of(text: str) -> frozenset[int]:
    return frozenset(int(x) for bucket, _, _ in features(pa.array([text])) for x in bucket)


def counterfactuals(text: str) -> list[list[str]]:
    """The words of each counterfactual copy of a text."""
    held = _WORD.findall(text.translate(_LOWER))
    mentioned = set(held)
    return [[other if w == term else w for w in held] for kind in IDENTITY_TERMS for term in kind if term in mentioned for other in kind if other != term]


def changes(text: str) -> list[tuple[list[int], list[int]]]:
    """The buckets that each counterfactual copy loses, and those that it gains."""
    copies = counterfactuals(text)
    own = _of(text) if copies else frozenset()
    made = [_of(" ".join(sorted(set(copy)))) for copy in copies]
    return [(sorted(own - new), sorted(new - own)) for new in made]


@dataclass
class Model:
    """Weights by bucket, the intercept and the curve (slope, intercept); without weights the share alone."""

    weights: np.ndarray | None
    intercept: float
    curve: tuple[float, float]
    share: float


class _Rows:
    """Sparse rows of ones (or given values)."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.n = len(rows)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.at = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate(values) if values else None
        self.width = BUCKETS

    def narrow(self, place: np.ndarray, width: int) -> None:
        """Columns get new places; entries of those without one (-1) go."""
        some = place[self.at] >= 0
        self.owner, self.at, self.width = self.owner[some], place[self.at[some]], width
        if self.values is not None:
            self.values = self.values[some]

    def dot(self, w: np.ndarray) -> np.ndarray:
        x = w[self.at] if self.values is None else w[self.at] * self.values
        return np.bincount(self.owner, x, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        x = g[self.owner] if self.values is None else g[self.owner] * self.values
        return np.bincount(self.at, x, self.width)


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, swaps: list[np.ndarray], penalty: float = PENALTY, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, by accelerated gradient steps over all rows.

    swaps: for each counterfactual copy its signed buckets, see _signed(); start: what an earlier fit found.
    """
    x = _Rows(rows)
    swapped = _Rows([np.abs(c) - 1 for c in swaps], [np.sign(c).astype(float) for c in swaps]) if swaps else None
    # each feature is scaled by its shrunken log-odds ratio, so that words of no account stay near nothing
    ones, share = x.back(y), y.mean()
    seen = x.back(np.ones(len(y)))
    ratio = np.log((ones + SHRINK * share) / (SHRINK * share)) - np.log((seen - ones + SHRINK * (1 - share)) / (SHRINK * (1 - share)))
    ratio -= np.log((len(y) * share + SHRINK * share) / (SHRINK * share)) - np.log((len(y) * (1 - share) + SHRINK * (1 - share)) / (SHRINK * (1 - share)))
    ratio[(seen == 0) | (np.abs(ratio) < LEAST)] = 0.0
    columns = np.flatnonzero(ratio)
    ratio, place = ratio[columns], np.full(BUCKETS, -1, np.int32)
    place[columns] = np.arange(len(columns))
    for held in (x, swapped) if swapped is not None else (x,):
        held.narrow(place, len(columns))
    g = weight / weight.sum()

    def curved(v: np.ndarray) -> np.ndarray:
        out = ratio * x.back(0.25 * g * x.dot(ratio * v)) + RIDGE * v
        return out if swapped is None else out + 2 * penalty / swapped.n * ratio * swapped.back(swapped.dot(ratio * v))

    v, top = np.ones(len(columns)), 1.0
    for _ in range(15):
        v = curved(v / max(1e-300, np.linalg.norm(v)))
        top = max(RIDGE, float(np.linalg.norm(v)))
    u, b = np.zeros(len(columns)), float(np.log((g * y).sum() / (g * (1 - y)).sum()))
    if start is not None:
        u, b = start[0][columns] / ratio, start[1]
    ahead = u
    for step in range(STEPS if start is None else AGAIN_STEPS):
        z = x.dot(ratio * ahead) + b
        off = g * (sigmoid(z) - y)
        grad = ratio * x.back(off) + RIDGE * ahead
        if swapped is not None:
            grad += 2 * penalty / swapped.n * ratio * swapped.back(swapped.dot(ratio * ahead))
        new = ahead - grad / (1.1 * top)
        ahead, u = new + step / (step + 3) * (new - u), new
        b -= 2.0 * off.sum()
    w = np.zeros(BUCKETS)
    w[columns] = ratio * u
    return w, b


def _signed(lost: list[int], gained: list[int]) -> np.ndarray:
    """Buckets counted from 1, below 0 if they are lost."""
    return np.array([-k - 1 for k in lost] + [k + 1 for k in gained], np.int32)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, rows: int = SAMPLE_ROWS, penalty: float = PENALTY) -> Model:
    """Learns from labels.toxic outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    texts, counts = sampled(docs, labels, "toxic", folds, held, rows)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total if total else 0.0

    def held_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, copies = [], []
            for bucket, bounds, _ in features(batch.column("text")):
                small = bucket.astype(np.int32)
                out += [small[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for text in batch.column("text"):
                copies.append([_signed(*c).tobytes() for c in changes(text.as_py())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(copies, pa.list_(pa.binary()))], ["doc_id", "label", "buckets", "swaps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(texts.mapInArrow(held_words, f"doc_id {kind}, label int, buckets binary, swaps array<binary>").collect(), key=lambda r: str(r[0]))
    found, y = [np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], float)
    swaps = [[np.frombuffer(c, np.int32) for c in r[3]] for r in got]
    del got
    if not 0 < y.sum() < len(y):
        return Model(None, 0.0, (1.0, 0.0), share)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    part = np.arange(len(y)) % 4 == 0
    if not (0 < y[part].sum() < part.sum() and 0 < y[~part].sum() < (~part).sum()):  # too few to keep some apart
        w, b = train(found, y, weight, [c for of in swaps for c in of], penalty)
        return Model(w.astype(np.float32), b, (1.0, 0.0), share)
    w, b = train([r for r, k in zip(found, part, strict=True) if not k], y[~part], weight[~part], [c for of, k in zip(swaps, part, strict=True) if not k for c in of], penalty)
    z = _Rows([r for r, k in zip(found, part, strict=True) if k]).dot(w) + b
    curve = tuple(float(c) for c in logistic(z, y[part], weight[part], ridge=0.1))
    w, b = train(found, y, weight, [c for of in swaps for c in of], penalty, (w, b))
    return Model(w.astype(np.float32), b, curve, share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.full(batch.num_rows, model.share)
            if model.weights is not None:
                for bucket, bounds, rows in features(batch.column("text")):
                    sums = np.concatenate(([0.0], np.cumsum(model.weights[bucket], dtype=np.float64)))
                    z = sums[bounds[1:]] - sums[bounds[:-1]] + model.intercept
                    values[rows.start : rows.stop] = sigmoid(model.curve[0] * z + model.curve[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
