"""Quality classifier: logistic regression on hashed word n-grams.

Words and runs of punctuation are tokens.  Features are the hashed token
unigrams and bigrams and bigrams of token shapes (lower case, title, upper case,
digits, punctuation, repetition of the token before), each family as its
relative frequencies, so that a text's length does not move its score.  Weights
come from follow-the-regularised-leader updates over a bounded sample of
labelled rows (``MAX_LABELLED`` rows with ``MAX_FEATURES`` features in all, both
parameters); scoring is a sparse dot product
per text, whole texts, without a shuffle.

Empty and null texts score by the bias alone.  Without labelled rows every score
is 0.5.  Repeated rows score alike, rows without an id are scored as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import crc_fold_value, slices, stateless, texts
from millrace.llm.linear import Sparse, collected, fit, labelled_sample, sigmoid

BITS = 18
SHAPES = 16
#: Labelled rows that the model is fitted on at most.
MAX_LABELLED = 4000
#: Features of these rows, all together, at most; later rows are left out.
MAX_FEATURES = 8_000_000
THRESHOLD = 0.3
#: Scale of the relative frequencies.
SCALE = 10.0
DIMENSIONS = (1 << BITS) + SHAPES * SHAPES + 1
BIAS = DIMENSIONS - 1

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


def _shape(token: str) -> int:
    if token.islower():
        return 1 if len(token) <= 3 else 2
    if token.isupper():
        return 3 if len(token) > 1 else 4
    if token[0].isupper():
        return 5
    if token.isdigit():
        return 6
    if token.isalnum():
        return 7
    return 8 + min(len(token), 4) if not token[0].isalnum() else 13


class _Codes(dict):
    """Token to hash * SHAPES + shape, bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        code = self[token] = (zlib.crc32(token.encode("utf-8")) & ((1 << BITS) - 1)) * SHAPES + _shape(token)
        return code


def _families(text: str, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the unigrams, bigrams and shape bigrams of a text, in order."""
    tokens = _TOKENS(text)
    values = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    hashes, shapes = values >> 4, values & (SHAPES - 1)
    shapes[1:][values[1:] == values[:-1]] = 14
    pairs = ((hashes[:-1] * 0x9E3779B1 + hashes[1:] * 0x85EBCA6B) >> 7) & ((1 << BITS) - 1)
    return hashes, pairs, (1 << BITS) + shapes[:-1] * SHAPES + shapes[1:]


def features(text: str, codes: _Codes | None = None) -> Sparse:
    """Relative frequencies of each family, and the bias."""
    parts, weights = [np.array([BIAS])], [np.array([1.0])]
    for family in _families(text, codes if codes is not None else _Codes()):
        if len(family):
            parts.append(family)
            weights.append(np.full(len(family), SCALE / len(family)))
    index, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return index, np.bincount(inverse, np.concatenate(weights))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0, most: int = MAX_LABELLED, most_features: int = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights, on the driver; what comes there is bounded by ``most`` and ``most_features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for part in slices(batch, 128):
                rows = [features(text, codes) for text in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())],
                    ["doc_id", "label", "i", "v"],
                )

    sample = labelled_sample(docs, labels, label_col, modulus, held_out, most, id_col, text_col)
    found = collected(sample.mapInArrow(stateless(run), "doc_id long, label int, i binary, v binary"), F.length("i") / 4, most_features)
    rows = [(np.frombuffer(row["i"], "<i4"), np.frombuffer(row["v"], "<f4").astype(float)) for row in found]
    return fit(rows, [row["label"] for row in found], DIMENSIONS, epochs=4, alpha=0.5, beta=0.1, l1=0.02, l2=0.1)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def _scorer(weights: np.ndarray):
    codes = _Codes()
    bias = float(weights[BIAS])

    def score(text: str) -> float:
        total = bias
        for family in _families(text, codes):
            if len(family):
                total += SCALE * float(weights[family].mean())
        return float(sigmoid(total))

    return score


def scored(docs: DataFrame, weights: np.ndarray, modulus: int = 5, held_out: int = 0, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; the weights are broadcast (a fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch):
                values = np.array([score(text) for text in texts(part.column(1))], np.float64)
                fold = [crc_fold_value(doc_id, modulus) == held_out for doc_id in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fold, pa.bool_()), pa.array(values), pa.array((values >= threshold).astype(np.int32))], SCORED.fieldNames())

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(stateless(run), SCORED)


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([score(text) >= threshold for text in texts(part.column(at))], pa.bool_()))

    return docs.mapInArrow(stateless(run), docs.schema)
