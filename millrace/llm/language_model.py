"""Language-model scoring with a hashed, class-factored maximum-entropy model.

The probability of a token is that of its class given the words before, times
that of the token in its class given them.  The most frequent ``SINGLES`` tokens
are classes of their own; all other words are classed by a hash of their last two
bytes.

The class is a softmax over hashed features of the history: the bigram (the word
before), a skip feature (the word before that) and the trigram of both, where
frequent words have codes of their own and others share by suffix.  The word in
its class is a second softmax, over hashed features that name the words
themselves: the bigram (word before, word), and after a frequent word the trigram
(two words before, word).  Its reference measure is each word's share of the
class's counts, with 0.1 added for each word; words beyond the broadcast ones
share what is left of their class alike, unknown words being one of them.

Training takes three distributed passes over the training documents:

1. Counts of all tokens, combined in each task before the shuffle; the table
   grows with the corpus and stays distributed.
2. Counts of (history, class), the class softmax's sufficient statistics: a table
   of fixed size that covers every training token.  In each of ``ITERATIONS``
   rounds the blocks of that table compute the expected feature counts under the
   present weights in parallel, and the difference to the observed ones moves the
   weights, scaled by curvature.
3. Counts of all word features, dealt to buckets by (history, class), so that a
   bucket holds whole softmaxes.  Buckets grow in number with the corpus.  Each
   takes ``WORD_ITERATIONS`` gradient updates of its weights against discounted
   counts; the discount comes from how many of its features occur once and twice.

The third pass carries, for each text, the features whose weights it needs, so
training and scoring share one shuffle: equal texts of a task are one before it, a
bucket answers with one sum per text, and no table of word features is ever broadcast or collected.  The
``TOP_WORDS`` most frequent words and their counts are broadcast (a fixed number);
for the base score the 64-bit hashes of rarer words are joined with the table of
counts, where no word can be frequent enough to skew the join.

Null and empty texts consist of the end token.  Repeated rows are scored one by
one.  A null id counts as the empty text for the fold.  Without training
documents all counts are 0 and classes are equally likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER_AZ, checkpointed, crc_fold, slices, stateless, text_bytes

END = b""
ADDED = 0.1
TOP_WORDS = 1 << 18
SINGLES = 32
SUFFIX_CLASSES = 96
CLASSES = SINGLES + SUFFIX_CLASSES
#: History codes of the word before and of the one before that: frequent words
#: have their own, others share by suffix, the first is the start of the text.
FIRST_OWN, FIRST = 128, 256
SECOND_OWN, SECOND = 32, 64
CONTEXTS = FIRST * SECOND
TRIGRAM_ROWS = 1 << 13
ROWS = 1 + FIRST + SECOND + TRIGRAM_ROWS
BLOCKS = 16
ITERATIONS = 12
RIDGE = 2.0
#: Words before, of so high a rank that their histories are told apart by one word more.
FREQUENT = 128
#: Bits of a feature's key that tell the words after one history apart.
WORD_BITS = 16
#: Words are told apart by their XXH64 with this seed, the one of Spark's function.
HASH_SEED = 42
WORD_ITERATIONS = 16
WORD_RIDGE = 0.01
#: Training tokens for each bucket of word features; the number of buckets is a power of two.
BUCKET_TOKENS = 1 << 20
#: Tokens and documents that a task holds before it deals their features to the buckets.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 1 << 15
#: What a bucket adds to a text's score is a multiple of this, in log10.
GAIN_UNIT = 1 / (1 << 16)
#: Map tasks whose statistics are added up before the blocks of all meet.
ADDED_TOGETHER = 32
#: Different words that one task counts before it hands on what it has.
MOST_COUNTED = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words, lower-cased A-Z, then the end token."""
    out = text.translate(LOWER_AZ).split()
    out.append(END)
    return out


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def handed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in slices(batch, 128):
            for text in text_bytes(part.column(0)):
                counts.update(tokens(text))
            if len(counts) > MOST_COUNTED:
                yield handed_on()
    yield handed_on()


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes, the end token empty), c; ``train`` has a column text."""
    return train.select("text").mapInArrow(stateless(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words, their codes, and the masses of the classes; bounded."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    masses: np.ndarray
    #: Different words by suffix class, those of their own class left out.
    kinds: np.ndarray

    def tables(self) -> dict[str, np.ndarray]:
        """By word code: class, history codes, log10(c + 0.1), log10 of the share of the class, hash.

        Codes below ``len(words)`` are words by rank, then come the suffix
        classes of all others.
        """
        n = len(self.words)
        suffixes = np.array([suffix(w) for w in self.words], np.int64)
        rank = np.arange(n)
        other = np.arange(SUFFIX_CLASSES * 8)  # suffixes modulo a multiple of all three moduli
        kind, masses = suffixes[SINGLES:] % SUFFIX_CLASSES, self.counts[SINGLES:] + ADDED
        left = self.masses - np.bincount(kind, masses, SUFFIX_CLASSES)
        unlisted = np.maximum(self.kinds - np.bincount(kind, minlength=SUFFIX_CLASSES), 0)
        share = np.log10(np.maximum(left, ADDED) / (unlisted + 1) / self.masses)
        return {
            "within": np.concatenate([np.zeros(min(n, SINGLES)), np.log10(masses / self.masses[kind]), share[other % SUFFIX_CLASSES]]),
            "hash": mixed(np.arange(1, n + len(other) + 1, dtype=np.uint64)),
            "class": np.concatenate([np.where(rank < SINGLES, rank, SINGLES + suffixes % SUFFIX_CLASSES), SINGLES + other % SUFFIX_CLASSES]).astype(np.int32),
            "first": np.concatenate([np.where(rank < FIRST_OWN - 1, 1 + rank, FIRST_OWN + suffixes % (SUFFIX_CLASSES * 8) % (FIRST - FIRST_OWN)), FIRST_OWN + other % (FIRST - FIRST_OWN)]).astype(np.int32),
            "second": np.concatenate([np.where(rank < SECOND_OWN - 1, 1 + rank, SECOND_OWN + suffixes % (SUFFIX_CLASSES * 8) % (SECOND - SECOND_OWN)), SECOND_OWN + other % (SECOND - SECOND_OWN)]).astype(np.int32),
            "log": np.concatenate([np.log10(self.counts + ADDED), np.zeros(len(other))]),
        }


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    """Word to code; words that aren't listed have the code of their suffix."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.listed = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.listed + zlib.crc32(word[-2:]) % (SUFFIX_CLASSES * 8)


def vocabulary(counts: DataFrame, top: int = TOP_WORDS) -> Vocabulary:
    """Collects at most ``top`` words and one row per class from the distributed counts.

    A histogram of the counts (exact below 4096, sixteenths of an octave above)
    gives the least count of which no more than ``top`` words are left, so that
    the driver gets those words alone.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(16 * F.log2("c") - 192)).cast("long")
    levels = sorted(((row["level"], row["n"]) for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, left = 1 << 62, top
    for at, n in levels:
        left -= n
        if left < 0:
            break
        least = at
    listed = counts.filter(level >= least).select("word", "c").toArrow()
    order = sorted(zip(listed.column("c").to_pylist(), listed.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    kinds = counts.groupBy((F.crc32(F.substring("word", -2, 2)) % SUFFIX_CLASSES).alias("k")).agg(F.sum(F.col("c") + ADDED).alias("mass"), F.count("*").alias("v")).collect()
    masses, different = np.full(SUFFIX_CLASSES, ADDED), np.zeros(SUFFIX_CLASSES, np.int64)
    for row in kinds:
        masses[row["k"]] += row["mass"]
        different[row["k"]] = row["v"]
    for c, word in order[:SINGLES]:
        masses[suffix(word) % SUFFIX_CLASSES] -= c + ADDED
        different[suffix(word) % SUFFIX_CLASSES] -= 1
    return Vocabulary([w for _, w in order], np.array([c for c, _ in order], np.int64), total["n"] or 0, total["v"], np.maximum(masses, ADDED), different)


def _contexts(codes: np.ndarray, starts: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
    """History of each token: first code * SECOND + second code; 0 before the start."""
    first, second = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    first[1:] = tables["first"][codes[:-1]]
    second[2:] = tables["second"][codes[:-2]]
    first[starts] = 0
    second[starts] = 0
    after = starts + 1
    second[after[after < len(codes)]] = 0
    return first * SECOND + second


def _coded(texts: list[bytes], codes: _Codes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text, all codes, and where each text starts."""
    found = [tokens(text) for text in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.empty(int(lengths.sum()), np.int64)
    starts = np.cumsum(lengths) - lengths
    for start, length, row in zip(starts.tolist(), lengths.tolist(), found):
        flat[start : start + length] = np.fromiter(map(codes.__getitem__, row), np.int64, length)
    return found, flat, starts


def statistics(train: DataFrame, words: Vocabulary) -> DataFrame:
    """(block, counts): blocks of the (history, class) counts over all training tokens."""
    shared = train.sparkSession.sparkContext.broadcast(words)
    cells = CONTEXTS * CLASSES // BLOCKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables = _Codes(shared.value.words), shared.value.tables()
        seen = np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch, 256):
                _, flat, starts = _coded(text_bytes(part.column(0)), codes)
                seen += np.bincount(_contexts(flat, starts, tables) * CLASSES + tables["class"][flat], minlength=len(seen))
        yield packed({block: counts for block, counts in enumerate(seen.reshape(BLOCKS, cells))})

    def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        at = [np.flatnonzero(b) for b in blocks.values()]
        columns = [pa.array(list(blocks), pa.int32()), pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()), pa.array([b[x].astype("<i8").tobytes() for b, x in zip(blocks.values(), at)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "cells", "counts"])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.setdefault(block, np.zeros(cells, np.int64))[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        return sums

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(sums_of(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sums_of(batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    parts = "block int, cells binary, counts binary"
    gathered = train.select("text").mapInArrow(stateless(gather), parts).withColumn("few", F.floor(F.spark_partition_id() / ADDED_TOGETHER))
    # a few tasks' counts at a time first, so that no block gets those of every task
    fewer = gathered.repartition("block", "few").select("block", "cells", "counts").mapInArrow(stateless(some), parts)
    return fewer.repartition("block").mapInArrow(stateless(add), "block int, counts binary").coalesce(BLOCKS)


def rows_of(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight rows of the bigram, skip and trigram feature of each context."""
    first, second = contexts // SECOND, contexts % SECOND
    trigram = ((first * 0x9E3779B1 + second * 0x85EBCA6B) >> 5) % TRIGRAM_ROWS
    return 1 + first, 1 + FIRST + second, 1 + FIRST + SECOND + trigram


def log_softmax(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    logits = weights[0] + sum(weights[rows] for rows in rows_of(contexts))
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train_classes(table: DataFrame, iterations: int = ITERATIONS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (ROWS x CLASSES) by gradient updates over the blocks of ``statistics``.

    Each round is one job that sends the weights out and gets feature counts back,
    both of the model's size (at most 10 MB).
    """
    context = table.sparkSession.sparkContext

    def feature_counts(weights: np.ndarray | None) -> np.ndarray:
        """Expected counts of (row, class) under the weights; observed ones for None."""
        shared = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts = np.frombuffer(content, np.int64).reshape(-1, CLASSES)
                    contexts = block * len(counts) + np.flatnonzero(counts.any(axis=1))
                    mine = counts[contexts - block * len(counts)].astype(np.float64)
                    if shared.value is not None:
                        mine = np.exp(log_softmax(shared.value, contexts)) * mine.sum(axis=1, keepdims=True)
                    sums: dict[int, np.ndarray] = {}
                    parts, rows = [], []
                    for row in (np.zeros(len(contexts), np.int64), *rows_of(contexts)):
                        different, inverse = np.unique(row, return_inverse=True)
                        total = np.zeros((len(different), CLASSES))
                        np.add.at(total, inverse, mine)
                        rows.append(different)
                        parts.append(total)
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(rows).astype("<i4").tobytes()], pa.binary()), pa.array([np.concatenate(parts).astype("<f4").tobytes()], pa.binary())], ["rows", "sums"])

        total = np.zeros((ROWS, CLASSES))
        for got in table.mapInArrow(stateless(run), "rows binary, sums binary").collect():
            rows = np.frombuffer(got["rows"], "<i4")
            np.add.at(total, rows, np.frombuffer(got["sums"], "<f4").reshape(len(rows), CLASSES))
        shared.destroy()
        return total

    observed = feature_counts(None)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    prior = observed[0] + 0.5
    weights[0] = np.log(prior / prior.sum())
    for _ in range(iterations):
        expected = feature_counts(weights)
        gradient = observed - expected - ridge * weights
        gradient[0] += ridge * weights[0]  # the prior itself isn't drawn to zero
        step = np.clip(gradient / (np.maximum(expected, observed / 4) + ridge), -2.0, 2.0)
        weights += (0.5 * step).astype(np.float32)
    return weights


_ENTRIES = "bucket long, uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare_words array<long>, rare_counts array<int>, n_texts int, keys binary, holders binary, texts binary, times binary, shares binary, copies binary"
_SUMS = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare_words array<long>, rare_counts array<int>, n_texts int, places binary, gains binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 6]


def feature_keys(hashes: np.ndarray, kinds: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed word feature of each token: 40 bits of history and class, 16 of the word.

    The history is the word before, and after a frequent one the two words before.
    """
    one, two = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    frequent = np.zeros(len(hashes), bool)
    frequent[1:] = codes[:-1] < FREQUENT
    one[starts], two[starts], frequent[starts] = 0, 0, False
    after = starts + 1
    two[after[after < len(hashes)]] = 0
    history = np.where(frequent, mixed(one + np.uint64(3) * two + np.uint64(1)), one)
    group = mixed(history ^ mixed(kinds.astype(np.uint64) + np.uint64(1)))
    return (group >> np.uint64(24) << np.uint64(WORD_BITS)) | (mixed(hashes) >> np.uint64(64 - WORD_BITS))


class _Block:
    """Features of a run of documents, to be dealt to the buckets; equal texts of the run are one.

    A text is known by the number of the run's first document plus its own place.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.uid, self.n_docs, self.tokens = 0, 0, 0
        self.places: dict[bytes, int] = {}
        self.trained: list[int] = []
        self.parts: list[tuple] = []

    def place(self, uid: int, text: bytes, trains: bool) -> tuple[int, bool]:
        """Place of a text, and whether it is new."""
        if not self.n_docs:
            self.uid = uid
        self.n_docs += 1
        at = self.places.setdefault(text, len(self.places))
        new = at == len(self.trained)
        if new:
            self.trained.append(0)
        self.trained[at] += trains
        return at, new

    def add(self, keys: np.ndarray, shares: np.ndarray, texts: np.ndarray) -> None:
        self.parts.append((keys, shares, texts))
        self.tokens += len(keys)

    def dealt(self) -> Iterator[tuple]:
        """Rows of one bucket each: the features, and of each the texts that hold it and how often."""
        keys, shares, texts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")  # tokens come by text, and stay so within a key
        keys, shares, texts = keys[order], shares[order], texts[order]
        entry = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])])) if len(keys) else np.empty(0, np.int64)
        times = np.diff(np.append(entry, len(keys)))
        keys, shares, texts = keys[entry], shares[entry], texts[entry]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        keys, shares, ends = keys[first], shares[first], np.append(first, len(texts))
        trained = np.array(self.trained, np.int64)
        texts = texts | np.where(trained[texts] > 0, BLOCK_DOCS, 0)
        several = np.flatnonzero(trained > 1)
        copies = np.column_stack([several, trained[several]]).astype("<u4").tobytes()
        buckets = (keys >> np.uint64(40 + WORD_BITS - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = [*np.flatnonzero(np.diff(buckets, prepend=-1)).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            steps = np.diff(keys[start:end], prepend=np.uint64(0))
            # bytes of one weight side by side, so that the zeros of sorted keys compress
            planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
            held = slice(ends[start], ends[end])
            yield (int(buckets[start]), self.uid, *(None,) * 8, len(trained), planes, np.diff(ends[start : end + 1]).astype("<u4").tobytes(), texts[held].astype("<u2").tobytes(), times[held].astype("<u4").tobytes(), shares[start:end].astype("<f2").tobytes(), copies)
        self.clear()


def _keys_of(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _local_scores(shared, probabilities, bits: int):
    """Rows of documents (buckets below 0), with what needs no other task, and the features dealt to the buckets."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)], [field.split(" ")[0] for field in _ENTRIES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = shared.value
        codes, tables, log_class = _Codes(words.words), words.tables(), probabilities.value.ravel()
        digest, block = xxhash.xxh64_intdigest, _Block(bits)
        for batch in batches:
            for part in slices(batch, 256):
                uids, held_out = part.column(0).to_pylist(), part.column(2).to_pylist()
                if block.n_docs and uids[0] != block.uid + block.n_docs:
                    rows = list(block.dealt())
                    if rows:
                        yield batch_of(rows)
                contents = text_bytes(part.column(3))
                found, flat, starts = _coded(contents, codes)
                kinds = tables["class"][flat]
                logs, within = tables["log"][flat], tables["within"][flat]
                model = log_class[_contexts(flat, starts, tables) * CLASSES + kinds].astype(np.float64) + within
                rare, hashes = flat >= codes.listed, tables["hash"][flat]
                # summed text by text, so that equal texts have equal sums
                ends = np.append(starts[1:], len(flat))
                rows, places, fresh = [], [], []
                for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
                    row, at, n = found[k], np.flatnonzero(rare[start:end]).tolist(), end - start
                    place, new = block.place(uids[k], contents[k], not held_out[k])
                    places.append(place)
                    fresh.append(new)
                    tail: Counter[int] = Counter()
                    for i in at if new else ():
                        hashes[start + i] = word_hash = digest(row[i], HASH_SEED)
                        tail[word_hash - (1 << 64) if word_hash >> 63 else word_hash] += 1
                    uid = block.uid + place
                    rows.append((-1 - uid % 997, uid, part.column(1)[k].as_py(), held_out[k], n, n - len(at), float(logs[start:end].sum()), float(model[start:end].sum()), list(tail.keys()), list(tail.values()), *(None,) * 7))
                yield batch_of(rows)
                lengths = ends - starts
                wanted = np.flatnonzero((kinds >= SINGLES) & np.repeat(np.array(fresh, bool), lengths))
                block.add(feature_keys(hashes, kinds, flat, starts)[wanted], -within[wanted], np.repeat(np.array(places), lengths)[wanted])
                if block.tokens >= BLOCK_TOKENS or block.n_docs > BLOCK_DOCS - 256:
                    rows = list(block.dealt())
                    if rows:
                        yield batch_of(rows)
        rows = list(block.dealt()) if block.n_docs else []
        if rows:
            yield batch_of(rows)

    return run


def fit_words(groups: np.ndarray, counts: np.ndarray, shares: np.ndarray, iterations: int = WORD_ITERATIONS, ridge: float = WORD_RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of word features and ln of the normaliser of each, by gradient updates.

    ``groups``: history and class of each feature, sorted; ``counts`` in training
    (0: unseen, without a weight); ``shares`` of the word in its class.  The
    probability of a word is ``share * exp(weight) / normaliser``.
    """
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(groups))))
    seen = counts > 0
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once + twice else 0.5
    wanted, totals = np.where(seen, counts - discount, 0.0), np.add.reduceat(counts, first)[number]
    weights = np.zeros(len(groups))

    def normalisers() -> np.ndarray:
        """1 where nothing is seen: the shares of a class sum to 1."""
        return np.maximum(1 + np.add.reduceat(np.where(seen, shares * np.expm1(weights), 0.0), first), 1e-6)[number]

    for _ in range(iterations):
        p = shares * np.exp(weights) / normalisers()
        gradient = wanted - totals * p - ridge * weights
        step = np.clip(gradient / (totals * p * (1 - np.minimum(p, 1.0)) + ridge), -2.0, 2.0)
        weights = np.where(seen, np.clip(weights + step, -30.0, 30.0), 0.0)
    return weights, np.log(normalisers())


def _bucket_gains(iterations: int):
    """Rows of documents as they are; for each run of texts what the word features add to their scores.

    The rows of a partition come sorted by bucket.
    """

    def gains(blocks: list[tuple]) -> pa.RecordBatch:
        holders = [np.frombuffer(b[3], "<u4") for b in blocks]
        keys = np.concatenate([np.repeat(_keys_of(b[2]), n) for b, n in zip(blocks, holders)])
        shares = np.concatenate([np.repeat(np.frombuffer(b[6], "<f2"), n) for b, n in zip(blocks, holders)])
        texts = [np.frombuffer(b[4], "<u2") for b in blocks]
        times = np.concatenate([np.frombuffer(b[5], "<u4") for b in blocks]).astype(np.float64)
        trained = np.concatenate([copies_of(b[1], t, b[7])[t & (BLOCK_DOCS - 1)] for b, t in zip(blocks, texts)]) * times
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        weights, normalisers = fit_words(keys[order][first] >> np.uint64(WORD_BITS), np.add.reduceat(trained[order], first), 10.0 ** -shares[order][first].astype(np.float64), iterations)
        values = np.empty(len(keys))
        values[order] = np.repeat((weights - normalisers) / np.log(10), np.diff(np.append(first, len(keys)))) * times[order]
        rows, at = [], 0
        for block, t in zip(blocks, texts):
            own = t & (BLOCK_DOCS - 1)
            total = np.bincount(own, values[at : at + len(t)], block[1])
            at += len(t)
            # of the texts that the bucket knows; whole multiples, so that sums agree in any order
            places = np.flatnonzero(np.bincount(own, minlength=block[1]))
            units = np.rint(total[places] / GAIN_UNIT).astype(np.int64)
            width = "<i4" if abs(units).max(initial=0) < 1 << 31 else "<i8"
            rows.append((block[0], block[1], np.diff(places, prepend=0).astype("<u2").tobytes(), units.astype(width).tobytes()))
        return sums_of(rows)

    def copies_of(n: int, texts: np.ndarray, copies: bytes) -> np.ndarray:
        """How many training documents have each of a run's texts."""
        out = np.zeros(n)
        out[texts[texts >= BLOCK_DOCS] - BLOCK_DOCS] = 1
        several = np.frombuffer(copies, "<u4").reshape(-1, 2)
        out[several[:, 0]] = several[:, 1]
        return out

    def sums_of(rows: list[tuple]) -> pa.RecordBatch:
        uids, sizes, places, units = zip(*rows)
        columns = [pa.array(uids, pa.int64()), *(pa.nulls(len(rows), kind) for kind in _KINDS[2:10]), pa.array(sizes, pa.int32()), pa.array(places, pa.binary()), pa.array(units, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [field.split(" ")[0] for field in _SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None
        for batch in batches:
            buckets = batch.column(0).to_numpy(zero_copy_only=False)
            rows = int(np.searchsorted(buckets, 0))
            if rows:
                plain = batch.slice(0, rows)
                yield pa.RecordBatch.from_arrays([*plain.columns[1:10], pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], [field.split(" ")[0] for field in _SUMS.split(", ")])
            dealt = batch.slice(rows)
            for at, *block in zip(buckets[rows:].tolist(), *(dealt.column(i).to_pylist() for i in (1, 10, 11, 12, 13, 14, 15, 16))):
                if at != bucket and held:
                    yield gains(held)
                    held = []
                bucket = at
                held.append(tuple(block))
        if held:
            yield gains(held)

    return run


def _gain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid of the first text, n_texts, places, gains) to one row per text; runs meet in one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for uid, n, places, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
            at = np.cumsum(np.frombuffer(places, "<u2"), dtype=np.int64)
            if len(at):
                sums.setdefault(uid, np.zeros(n, np.int64))[at] += np.frombuffer(content, f"<i{len(content) // len(at)}")
    for uid, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(total))), pa.array(total * GAIN_UNIT)], ["uid", "gain"])


def scored(docs: DataFrame, modulus: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", top: int = TOP_WORDS, iterations: int = ITERATIONS, word_iterations: int = WORD_ITERATIONS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("held_out", crc_fold(F.col("doc_id"), modulus) == held_out)
    train = rows.filter(~F.col("held_out"))
    counts = checkpointed(word_counts(train))
    words = vocabulary(counts, top)
    weights = train_classes(checkpointed(statistics(train, words)), iterations)
    table = (log_softmax(weights, np.arange(CONTEXTS)) / np.log(10)).astype(np.float32)
    bits = max(0, (words.total // bucket_tokens).bit_length())
    dealt = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(stateless(_local_scores(context.broadcast(words), context.broadcast(table), bits)), _ENTRIES)
    local = checkpointed(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(stateless(_bucket_gains(word_iterations)), _SUMS))
    plain = local.filter("gains is null")
    rare = plain.select("uid", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("r")).select("uid", F.col("r.rare_words").alias("rare_hash"), F.col("r.rare_counts").alias("times"))
    found = rare.join(counts.select(F.xxhash64("word").alias("word_hash"), "c"), F.col("rare_hash") == F.col("word_hash"), "left")
    zero = F.lit(0.0)
    gains = local.filter("gains is not null").select("uid", "n_texts", "places", "gains").repartition("uid").mapInArrow(stateless(_gain_rows), "uid long, gain double")
    parts = found.select(
        "uid",
        (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("log"),
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("known"),
        zero.alias("gain"),
    ).unionByName(gains.select("uid", zero.alias("log"), F.lit(0).cast("long").alias("known"), "gain"))
    sums = parts.groupBy(F.col("uid").alias("sums_uid")).agg(F.sum("log").alias("rare_log"), F.sum("known").alias("rare_known"), F.sum("gain").alias("gain"))
    base = F.lit(float(np.log10(words.total + ADDED * (words.distinct + 1))))
    return plain.drop("rare_words", "rare_counts").join(sums, F.col("uid") == F.col("sums_uid"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", zero) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + F.coalesce("gain", zero)).alias("score"),
    )
