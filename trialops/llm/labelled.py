"""Bounded training samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], held_out: Column) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` whole texts of each label, in the order of a hash of their id.

    Rows for which ``held_out`` holds are never taken; null labels and labels without a document
    do not count; of several labels of a document the largest does.  Of several texts of an id the
    one of the smallest hash counts, chosen before anything reaches the driver.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out)
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("y") == y).select("doc_id", "y").orderBy(order, "doc_id").limit(n) for y, n in per_class.items()]
    picked = chosen[0]
    for more in chosen[1:]:
        picked = picked.unionByName(more)
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    texts = found.agg(least.alias("t")).select("doc_id", "y", "t.text").toPandas().sort_values("doc_id")
    return [t or "" for t in texts["text"]], texts["y"].to_numpy(np.int64)


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    weights = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        step = np.linalg.solve((features.T * (p * (1 - p))) @ features + ridge * np.eye(len(weights)), features.T @ (labels - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights
