"""Sparse logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, crc_fold

#: One row of features: indices (each once) and their values.
Sparse = tuple[np.ndarray, np.ndarray]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 for sparsity, L2 for size.

    The first ``rising`` coordinates are held at zero or above.
    """

    def __init__(self, dimensions: int, alpha: float, beta: float, l1: float, l2: float, rising: int = 0):
        self.rising = rising
        self.z = np.zeros(dimensions)
        self.n = np.zeros(dimensions)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        pulled = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        found = -pulled / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        if self.rising:
            found = np.where(np.arange(len(self.z))[index] < self.rising if isinstance(index, slice) else index < self.rising, np.maximum(found, 0.0), found)
        return found

    def score(self, row: Sparse) -> float:
        return float(self.weights(row[0]) @ row[1])

    def update(self, index: np.ndarray, gradient: np.ndarray) -> None:
        """``gradient`` of the loss at the present weights, for those coordinates."""
        n = self.n[index]
        after = n + gradient * gradient
        self.z[index] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.alpha * self.weights(index)
        self.n[index] = after


def fit(rows: Sequence[Sparse], labels: Sequence[int], dimensions: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int = 7) -> np.ndarray:
    """Dense weights of a logistic regression; zeros where there are no rows."""
    model = Ftrl(dimensions, alpha, beta, l1, l2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, values = rows[i]
            model.update(index, (sigmoid(model.score(rows[i])) - labels[i]) * values)
    return model.weights()


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents outside the held-out fold.

    Chosen by the hash of the id among the labels whose documents are there, so reruns
    agree and labels of other documents take no place.  Only this bounded sample of
    ids is broadcast against the documents.  Rows with a null id or label are
    left out, repeated labels count once, and of the rows that repeat an id the
    one with the smallest text (a null text is empty).
    """
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("int").alias("label")).filter("label_id is not null and label is not null")
    known = known.filter(crc_fold(F.col("label_id"), modulus) != held_out).groupBy("label_id").agg(F.max("label").alias("label"))
    there = docs.select(docs[id_col].cast("long").alias("doc_id"))
    chosen = checkpointed(known.join(there, F.col("doc_id") == F.col("label_id"), "left_semi").orderBy(F.xxhash64("label_id"), "label_id").limit(most))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def collected(featured: DataFrame, size: Column, most: int) -> list:
    """The rows of a sample by the hash of their id, as many as fit into ``most`` features together.

    A row that doesn't fit any more is passed over, and those after it are still
    taken where they do.  What the driver gets first is one size per row of the
    sample, which is bounded.
    """
    kept = checkpointed(featured.withColumn("size", size).withColumn("place", F.xxhash64("doc_id")))
    total, fitting = 0, []
    for row in sorted(kept.select("place", "doc_id", "size").collect()):
        if total + row["size"] <= most:
            total += row["size"]
            fitting.append((row["doc_id"],))
    taken = kept.sparkSession.createDataFrame(fitting, "fitting_id long")
    return sorted(kept.join(F.broadcast(taken), F.col("doc_id") == F.col("fitting_id")).collect(), key=lambda row: row["doc_id"])
