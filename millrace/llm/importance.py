"""Importance resampling towards a target distribution.

Features are runs of one to ``max_n`` consecutive words, hashed into buckets.  A
bucket's gain is a thousand times the log of how much likelier it is in the target
than in the corpus, with one added to each count, rounded down; a document's
weight is the sum of the gains of its features.  The weight and a Gumbel draw from
the hash of seed and id make the score, and the highest scores are the sample: so
documents are drawn without replacement, in proportion to their likelihood ratios.

Counts cover all texts.  Each task adds up one array of counts, and scores texts
by sums over the array of gains, which has a fixed size.  The scored rows, without
texts, are written; the k-th key of the order (score, then id, then number of
features, then place in the written table) is found by radix selection: a job
counts the rows by the next ``DIGIT`` bits of the key among those that share the
bits found so far, until one bin holds all that is still wanted.  The driver gets
at most 2^``DIGIT`` counts a round.  Only the drawn rows are sorted, in range
partitions, and ranked by partition totals and places.

Null texts have no words.  Documents with fewer than ``min_words`` words are scored
and never drawn.  A null id is hashed as if it had no digits, and comes after all
others of its score.  Repeated ids and rows count one by one; of rows that agree in
all of the order, as many as are wanted are drawn, those first written.  An empty
corpus gives no rows, an empty target a flat distribution.  Other columns play no
part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, slices, stateless, text_bytes

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit of the radix selection.
DIGIT = 16
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Different words whose hash a task keeps.
MOST_KEPT = 200_000

#: bytes.translate table: A-Z lower-cased, what isn't part of a word to a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


class _Crc(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        found = self[word] = zlib.crc32(word)
        return found


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in turn, some ``PIECE`` bytes at a time."""
    plain = text.translate(_WORDS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def hashed_features(text: bytes, max_n: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    """crc32 of the runs of 1 to ``max_n`` words; words come first, so ``max_n`` arrays make up a piece."""
    before: list[bytes] = []
    for words in pieces(text):
        yield np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if max_n > 1:
            run, tail = before + words, len(before)
            for n in range(2, max_n + 1):
                # runs that end in this piece
                first = max(tail - n + 1, 0)
                yield np.array([zlib.crc32(b" ".join(run[i : i + n])) for i in range(first, len(run) - n + 1)], np.int64)
            before = run[max(len(run) - max_n + 1, 0) :]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """Features of all texts by bucket, on the driver: ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(buckets, np.int64), _Crc()
        for batch in batches:
            for part in slices(batch):
                for text in text_bytes(part.column(0)):
                    for hashes in hashed_features(text, max_n, known):
                        counts += np.bincount(hashes % buckets, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["bucket", "n"])

    by_task = texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(stateless(run), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) by bucket, of the two smoothed distributions."""
    size, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, max_n: int = MAX_N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, known = shared.value, _Crc()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in text_bytes(part.column(1)):
                    words = features = weight = 0
                    for k, hashes in enumerate(hashed_features(text, max_n, known)):
                        words += len(hashes) if k % max_n == 0 else 0
                        features += len(hashes)
                        weight += int(value[hashes % len(value)].sum())
                    rows.append((words, features, weight))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ())))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(stateless(run), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(drawn))))


def first_rows(rows: DataFrame, order: Sequence[Column], k: int) -> Column:
    """Condition that holds for exactly the first ``k`` of ``rows`` in ascending ``order`` (longs without nulls, unique together).

    ``rows`` must be a written table: it is read once for each digit.
    """
    total = rows.count()
    if k <= 0 or total <= k:
        return F.lit(k > 0)
    inside = F.lit(True)  # the rows that agree with the k-th in the bits found so far
    done: list[Column] = []  # conditions for the rows before those, one for each part
    for part in order:
        low, high = rows.filter(inside).agg(F.min(part), F.max(part)).first()
        shift, whole = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64, inside
        while shift > 0:
            shift = max(0, shift - DIGIT)
            counts = sorted((row[0], row[1]) for row in rows.filter(inside).groupBy(F.shiftright(part, shift)).count().collect())
            for digits, n in counts:
                if n >= k:
                    break
                k -= n
            inside = whole & (F.shiftright(part, shift) == F.lit(digits))
            if n == k:
                return reduce(lambda a, b: a | b, done, whole & (F.shiftright(part, shift) <= F.lit(digits)))
        bound = digits if low != high else low
        done.append(whole & (part < F.lit(bound)))
        inside = whole & (part == F.lit(bound))
    raise ValueError("the order leaves rows that agree")


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their rank (from 1) in ascending ``order``: range partitions, sorted and written; the driver gets their sizes."""
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_in_part", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    before, starts = 0, []
    for part, n in sorted(tuple(row) for row in placed.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_of long, _before long")
    return placed.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("rank", F.col("_before") + F.col("_in_part") + 1).drop("_place", "_part", "_in_part", "_of", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, max_n: int = MAX_N, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn); one row per row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, buckets, max_n), bucket_counts(target, target_col, buckets, max_n))
    rows = scored(docs, gain, seed, max_n, id_col, text_col)
    keys = [F.bitwise_not("score").alias("_down"), F.col("doc_id").isNull().cast("long").alias("_no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id")]
    stored = checkpointed(rows.select("doc_id", "n_words", "n_features", "weight", "score", *keys)).withColumn("_at", F.monotonically_increasing_id())
    fit = F.col("n_words") >= min_words
    able = stored.filter(fit)
    order = ["_down", "_no_id", "_id", "n_features", "_at"]
    chosen = first_rows(able, [F.col(x) for x in order], able.count() * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(stored.filter(fit & chosen), order).select(*columns, "rank")
    return drawn.unionByName(stored.filter(~(fit & chosen)).select(*columns, F.lit(None).cast("long").alias("rank")))
