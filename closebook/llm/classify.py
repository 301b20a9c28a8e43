"""Shared by the classifiers: labelled rows, folds, and a calibrated probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICT_FROM = 0.7


def fold(df: DataFrame, parts: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id is of an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows of each class, outside the held-out fold.

    Rows are taken in the order of a hash of their id. A repeated id counts once, with its
    largest label; null labels and ids are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(labels, parts) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    classes = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return classes[0].unionByName(classes[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def temperature(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The divisor of scores z, from a fixed grid, with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(5), 61))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(z / t), 1e-9, 1 - 1e-9)
        return float(-(weights * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    return float(min(grid, key=loss)) if len(z) else 1.0
