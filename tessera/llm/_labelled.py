"""A bounded, repeatable sample of labelled rows, and calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of each class that a classifier is fitted on.
SAMPLE_ROWS = 4000


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sampled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts outside the held-out fold, at most so many of each class, chosen by a hash; and the class counts.

    Returns doc_id, label, text and the counts over all training labels. Rows with null id or label teach nothing, nor
    do ids with labels of both classes; of an id with several texts the smallest teaches.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter(F.col("label") == F.col("most")).drop("most")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    ids = reduce(DataFrame.unionByName, chosen)  # at most 2 * rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a small logistic model (intercept last), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
