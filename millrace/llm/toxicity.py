"""Toxicity classifier with counterfactual regularisation.

A logistic regression on the different words of a text and their stems (hashed),
trained by follow-the-regularised-leader updates on a bounded sample of labelled
rows.  Where a labelled text mentions an identity group, its counterfactuals are
made: for each term in it and each other term of the same list, the text with
the one in place of the other, and the text that names no group there.  The mean
squared difference of the scores is penalised.  So the terms themselves cannot carry the label, and a neutral
mention of a group is no reason for a high score, while the words around it still
are.

Empty and null texts score by the bias alone.  Without labelled rows every score
is 0.5.  Repeated rows score alike, rows without an id are scored as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_fold_value, slices, stateless, texts
from millrace.llm.linear import Ftrl, collected, labelled_sample, sigmoid
from millrace.llm.quality import SCORED

#: Labelled rows that the model is fitted on at most.
MAX_LABELLED = 8000
#: Characters of their different words, all together, at most; later rows are left out.
MAX_CHARS = 64 << 20
THRESHOLD = 0.7
#: Weight of the squared score difference.
PENALTY = 1.0
#: Shrinkage of word weights at ``MAX_LABELLED`` rows.
L1 = 4.0
#: Weight by feature hash (those that are not zero), and the bias.
Weights = tuple[dict[int, float], float]
#: Lengths of the stems of a word that are features of their own.
STEMS = (4, 5)

# Identity terms; those of one list are exchanged for one another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("femmes", "hommes"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("frauen", "männer"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    ("mujeres", "hombres"),
)

_WORDS = re.compile(r"\w+").findall


def words(text: str) -> set[str]:
    """The different words, lower-cased."""
    return set(_WORDS(text.lower()))


def counterfactuals(found: set[str], lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """The words with one identity term replaced, for every term and alternative.

    Alternatives are the other terms of its list, and none: were only groups
    swapped, all of them could share one high weight.  One term at a time, so that
    a text that names two groups of a list does not become itself.
    """
    return [(found - {term}) | ({other} if other else set()) for term, other in exchanges(found, lists)]


def exchanges(found: set[str], lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[str, str | None]]:
    """(term, what stands in its place) for every term of the lists among the words, None being nothing."""
    return [(term, other) for terms in lists for term in terms if term in found for other in [None, *(x for x in terms if x != term)]]


def _slots(word: str) -> tuple[int, ...]:
    """Features of one word as 64-bit hashes: itself, and its stems where it is longer than those.

    So wide that a long text doesn't hit a weighty feature by chance.
    """
    digest = xxhash.xxh64_intdigest
    return (digest(word.encode("utf-8")), *(digest(b"^" + word[:n].encode("utf-8")) for n in STEMS if len(word) > n))


def features(found: set[str]) -> np.ndarray:
    """The different features of a text, sorted."""
    return np.unique(np.array([slot for word in found for slot in _slots(word)], np.uint64))


def moved(found: set[str], lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each counterfactual, the features that go and those that come; a handful, however long the text."""
    pairs = exchanges(found, lists)
    held = Counter(slot for word in found for slot in _slots(word)) if pairs else {}
    out = []
    for term, other in pairs:
        old, new = set(_slots(term)), set(_slots(other)) if other and other not in found else set()
        stays = {slot for slot in old | new if held.get(slot, 0) > (slot in old)}
        out.append(tuple(np.array(sorted(side - stays), np.uint64) for side in (old - new, new - old)))
    return out


def fit(rows: Sequence[set[str]], labels: Sequence[int], epochs: int = 12, alpha: float = 4.0, beta: float = 1.0, l1: float = L1, l2: float = 0.1, penalty: float = PENALTY, seed: int = 11, lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Weights:
    """Weights of log loss plus ``penalty`` times the mean squared score difference of the counterfactuals.

    Features of a single row are left out.  Weights of words are zero or more:
    toxic words raise a score, and no number of others in a long text takes it
    back.  ``l1`` is for ``MAX_LABELLED`` rows and shrinks with the root of their
    number, to half at most.
    """
    own = [features(found) for found in rows]
    # of each counterfactual only what it changes is kept: the features that go, and those that come
    swaps = [moved(found, lists) for found in rows]
    every, times = np.unique(np.concatenate([np.empty(0, np.uint64), *own, *(come for xs in swaps for _, come in xs)]), return_counts=True)
    for row, xs in zip(own, swaps):
        # each counterfactual has the row's features once more, but for those that go
        if xs:
            times[np.searchsorted(every, row)] += len(xs)
        for gone, _ in xs:
            times[np.searchsorted(every, gone)] -= 1
    every = every[times > 1]
    del times
    bias = len(every)

    def placed(row: np.ndarray) -> np.ndarray:
        at = np.searchsorted(every, row)
        at = at[at < bias]
        return at[np.isin(every[at], row, assume_unique=True)]

    def change(gone: np.ndarray, come: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features that only one of the two texts has, and the sign of their part in the difference."""
        gone, come = placed(gone), placed(come)
        at = np.concatenate([gone, come])
        order = np.argsort(at)
        return at[order], np.concatenate([np.ones(len(gone)), -np.ones(len(come))])[order]

    own = [np.append(placed(x), bias) for x in own]
    swaps = [[change(*pair) for pair in xs] for xs in swaps]
    model = Ftrl(bias + 1, alpha, beta, l1 * max(0.25, min(1.0, len(rows) / MAX_LABELLED)) ** 0.5, l2, rising=bias)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            score = float(model.weights(own[i]).sum())
            model.update(own[i], np.full(len(own[i]), sigmoid(score) - labels[i]))
            for index, sign in swaps[i]:
                difference = float(model.weights(index) @ sign)
                model.update(index, 2 * penalty / len(swaps[i]) * difference * sign)
    weights = model.weights()
    kept = np.flatnonzero(weights[:-1])
    return {int(every[i]): float(weights[i]) for i in kept}, float(weights[-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held_out: int = 1, most: int = MAX_LABELLED, most_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights, on the driver; what comes there is the words of at most ``most`` rows, ``most_chars`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                found = [" ".join(sorted(words(text))) for text in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.string())], ["doc_id", "label", "words"])

    sample = labelled_sample(docs, labels, label_col, modulus, held_out, most, id_col, text_col)
    found = collected(sample.mapInArrow(stateless(run), "doc_id long, label int, words string"), F.length("words"), most_chars)
    return fit([set(row["words"].split()) for row in found], [row["label"] for row in found])


class Scorer(dict):
    """Word to those of its features that have a weight, bounded."""

    def __init__(self, weights: Weights):
        super().__init__()
        self.weights, self.bias = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        slots = self[word] = tuple(slot for slot in _slots(word) if slot in self.weights)
        return slots

    def score(self, text: str) -> float:
        """Probability; summed in order of the features, so equal texts score equally."""
        present: set[int] = set()
        for slots in map(self.__getitem__, words(text)):
            if slots:
                present.update(slots)
        return float(sigmoid(sum((self.weights[slot] for slot in sorted(present)), self.bias)))


def scored(docs: DataFrame, weights: Weights, modulus: int = 3, held_out: int = 1, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value).score
        for batch in batches:
            for part in slices(batch):
                values = np.array([score(text) for text in texts(part.column(1))], np.float64)
                fold = [crc_fold_value(doc_id, modulus) == held_out for doc_id in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fold, pa.bool_()), pa.array(values), pa.array((values >= threshold).astype(np.int32))], SCORED.fieldNames())

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(stateless(run), SCORED)
