"""SimHash near-duplicates over an inverted index of byte positions.

A fingerprint of 64 bits has eight bytes.  Two fingerprints that differ in at
most ``max_bits`` bits share at least ``8 - max_bits`` bytes at their positions,
the guaranteed minimum of matches.  So of any ``index_bytes + max_bits`` positions
they share at least ``index_bytes``: the inverted index lists each different
fingerprint under every combination of that many (position, byte) pairs among
the first positions.  Every pair that meets on a list has its shared positional
bytes tallied, pairs below the minimum are dropped, and what is retained is
verified on all 64 bits.  Three index bytes make 35 lists a fingerprint; where
there are so many fingerprints that 24 bits would bring strangers together,
four make 70.  Both give the same links.

Equal fingerprints are one entry of the index, so copies never multiply.  Lists
of up to ``SMALL`` are tallied pair by pair; longer ones (a ball of near copies)
are not expanded into pairs: fingerprints join a pivot within reach of them, and
only pivots whose distance allows members to reach each other are compared
member by member, until the list's links are spanned.  No task solves a list of
more than ``LONG``: such a list is dealt anew, its members under each further
positional byte that a pair must share, then under combinations of half bytes,
after which 48 bits are shared and no list can exceed 65,536.

Texts without words, empty and null ones have fingerprint zero and link like any
other.  Repeated rows are each reported.  Rows with a null id get a fingerprint
and the component of their fingerprint's smallest id, null if there is none; a
fingerprint that only null ids bear links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER_AZ, checkpointed, popcount64, slices, stateless, text_bytes
from millrace.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Members of a list up to which all its pairs are tallied at once.
SMALL = 8
#: Members of a list up to which one task solves it as it is.
LONG = 1 << 14
#: Shingles whose bits are counted at a time; bounds the memory of one long text.
BLOCK = 1 << 14


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> Iterator[bytes]:
    """Space-joined runs of words, lower-cased A-Z, repeats included."""
    found = text.translate(LOWER_AZ).split()
    if not found:
        return
    joined = b" ".join(found)
    if len(found) <= words:
        yield joined
        return
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    for start, end in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()):
        yield joined[start:end]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(shingle, seed) for shingle in shingles(text, words)], np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED, hashed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and text_hash if ``hashed``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = np.array([fingerprint(text, words, seed) for text in text_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    extra = [_text_hash(docs, text_col).alias("text_hash")] if hashed else []
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *extra).mapInArrow(stateless(run), "doc_id long, fp long" + ", text_hash long" * hashed)


def _text_hash(docs: DataFrame, text_col: str) -> Column:
    """Tells the texts of one id apart; null and empty ones are alike."""
    return F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def index_bytes_for(n: int) -> int:
    """Shared bytes that a list is keyed by: four where lists of three would hold several strangers."""
    return 3 if n <= 1 << 25 else 4


def _bytes_of(prints: np.ndarray) -> np.ndarray:
    """n x 8: the bytes of signed fingerprints by position, the highest first."""
    return np.ascontiguousarray(prints.astype(">i8")).view(np.uint8).reshape(-1, 8)


def _mixed(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Keys of finer lists; lists that meet by chance cost time, never a result."""
    out = (keys.view(np.uint64) ^ (more.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


_POSTINGS = "list long, mask int, fp long, rep long"


def _postings(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], ["list", "mask", "fp", "rep"])


def _index(max_bits: int, index_bytes: int):
    """Postings of each fingerprint: one for each combination of positions, with the mask of these."""
    chosen = list(combinations(range(index_bytes + max_bits), index_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                prints, reps = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                columns = _bytes_of(prints).astype(np.int64)
                parts = []
                for i, positions in enumerate(chosen):
                    key = np.full(len(prints), i, np.int64)
                    for position in positions:
                        key = (key << 8) | columns[:, position]
                    parts.append((key, np.full(len(prints), sum(1 << p for p in positions)), prints, reps))
                yield _postings(parts)

    return run


def _finer(max_bits: int):
    """Postings of long lists once more, on lists that share more.

    While fewer bytes than the minimum are shared, a pair has a further one in
    common; after that, of the half bytes of the ``max_bits`` other positions at
    least as many as there are such positions.  Mask 0 says that nothing finer
    follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                keys, masks, prints, reps = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                columns = _bytes_of(prints).astype(np.int64)
                parts = []
                for mask in np.unique(masks).tolist():
                    mine = masks == mask
                    others = [p for p in range(8) if not mask >> p & 1]
                    at, k, fps, ids = columns[mine], keys[mine], prints[mine], reps[mine]
                    if len(others) > max_bits:
                        parts += [(_mixed(k, at[:, p] | p << 8), np.full(len(k), mask | 1 << p), fps, ids) for p in others]
                        continue
                    halves = [at[:, p] >> shift & 15 for p in others for shift in (4, 0)]
                    for i, positions in enumerate(combinations(range(len(halves)), len(others))):
                        more = np.full(len(k), i, np.int64)
                        for h in positions:
                            more = more << 4 | halves[h]
                        parts.append((_mixed(k, more), np.zeros(len(k), np.int64), fps, ids))
                yield _postings(parts)

    return run


def matches(differing: np.ndarray) -> np.ndarray:
    """The tally of each pair: how many positional bytes agree where ``differing`` is their exclusive or."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=-1)


def near(one: np.ndarray, other: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs link: tallied, retained at the guaranteed minimum of matches, then verified on all bits."""
    differing = one ^ other
    out = matches(differing) >= 8 - max_bits
    out[out] = popcount64(differing[out]) <= max_bits
    return out


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Verified links (positions) that span the components of one list.

    Members within reach of a pivot are linked to it.  Two groups are compared
    only where the triangle inequality leaves room for a link and they are not
    connected yet.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    pivots: list[int] = []
    groups: list[np.ndarray] = []
    while len(left):
        pivot = left[0]
        close = near(prints[left], prints[pivot], max_bits)
        members = left[close]
        pivots.append(int(pivot))
        groups.append(members)
        links.extend((int(pivot), int(m)) for m in members if m != pivot)
        left = left[~close]
    if len(pivots) == 1:
        return links
    union = _Union(len(pivots))
    at = prints[np.array(pivots)]
    for i in range(len(pivots)):
        candidates = np.flatnonzero(popcount64(at[i + 1 :] ^ at[i]) <= 3 * max_bits) + i + 1
        for j in candidates.tolist():
            if union.find(i) == union.find(j):
                continue
            one, two = groups[i], groups[j]
            rows = max(1, (1 << 20) // len(two))
            for start in range(0, len(one), rows):
                part = one[start : start + rows]
                hits = near(prints[part][:, None], prints[two][None, :], max_bits)
                if hits.any():
                    a, b = np.unravel_index(int(hits.argmax()), hits.shape)
                    links.append((int(part[a]), int(two[b])))
                    union.join(i, j)
                    break
    return links


def _list_links(max_bits: int, long: int):
    """Links within each list; the rows of a partition come sorted by list.

    Rows out are links (mask -1, ends in fp and rep) and, of lists longer than
    ``long`` that can be dealt finer, their postings as they came.
    """

    def solve(keys: np.ndarray, prints: np.ndarray, reps: np.ndarray) -> list[tuple]:
        src, dst = [], []
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        # small lists, the bulk of them, by size all at once
        for size in range(2, SMALL + 1):
            first = starts[sizes == size]
            for i, j in combinations(range(size), 2) if len(first) else ():
                linked = first[near(prints[first + i], prints[first + j], max_bits)]
                src.append(reps[linked + i])
                dst.append(reps[linked + j])
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found = spanning_links(prints[start : start + size], max_bits)
            if found:
                pairs = np.array(found) + start
                src.append(reps[pairs[:, 0]])
                dst.append(reps[pairs[:, 1]])
        n = sum(map(len, src))
        return [(np.zeros(n, np.int64), np.full(n, -1), np.concatenate(src), np.concatenate(dst))] if n else []

    def parts_of(handed: set[int], keys, masks, prints, reps) -> list[tuple]:
        """Links of whole lists; the last part of a list that was handed on goes after it."""
        end = int(np.searchsorted(keys, keys[0], "right")) if int(keys[0]) in handed else 0
        parts = [(keys[:end], masks[:end], prints[:end], reps[:end])] if end else []
        return parts + (solve(keys[end:], prints[end:].view(np.uint64), reps[end:]) if end < len(keys) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handed: set[int] = set()
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held)]
            # the last list may go on in the next batch
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            parts = parts_of(handed, *(x[:cut] for x in columns)) if cut else []
            held = [x[cut:] for x in columns]
            if len(held[0]) > long and held[1][0]:
                parts.append(tuple(held))  # handed on; what is left of the list follows likewise
                handed.add(int(held[0][0]))
                held = [x[:0] for x in held]
            if parts:
                yield _postings(parts)
        parts = parts_of(handed, *held) if len(held[0]) else []
        if parts:
            yield _postings(parts)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, index_bytes: int | None = None, long: int = LONG) -> DataFrame:
    """(fp, rep) with different fps to links (src, dst) between their reps."""
    if index_bytes is None:
        index_bytes = index_bytes_for(distinct.count())
    postings = distinct.select("fp", "rep").mapInArrow(stateless(_index(max_bits, min(index_bytes, 8 - max_bits))), _POSTINGS)
    found = None
    while True:
        solved = checkpointed(postings.repartition("list").sortWithinPartitions("list").mapInArrow(stateless(_list_links(max_bits, long)), _POSTINGS))
        linked = solved.filter("mask = -1").select(F.col("fp").alias("src"), F.col("rep").alias("dst"))
        found = linked if found is None else found.unionByName(linked)
        rest = solved.filter("mask >= 0")
        if rest.isEmpty():
            return found.distinct()
        postings = rest.mapInArrow(stateless(_finer(max_bits)), _POSTINGS)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(distinct.filter("rep is not null"), max_bits))
    classes = distinct.join(roots, distinct.rep == roots.node, "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("component_id"))
    return prints.join(classes, prints.fp == classes.class_fp, "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of fingerprints, with all its columns.

    It is the row with the smallest id.  Where ids repeat, rows are told apart by
    id and text: each belongs to the component of its own text (so different
    texts of one id may both stay), and among a component's rows of the smallest
    id the one with the smallest fingerprint, then text hash, stays.  Of rows
    equal in id and text any one stays; a null text counts as empty.

    Rows with a null id stay: nothing tells them from one another.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, hashed=True).filter("doc_id is not null"))
    # components of fingerprints, whose nodes no repeated id can join
    distinct = checkpointed(prints.select("fp").distinct())
    roots = connected_components(links(distinct.withColumn("rep", F.col("fp"))))
    alike = prints.groupBy("doc_id", "fp", "text_hash").agg(F.count("*").alias("n"))
    alike = checkpointed(alike.join(roots, alike.fp == roots.node, "left").select("doc_id", "fp", "text_hash", "n", F.coalesce("root", "fp").alias("component")))
    best = checkpointed(alike.groupBy("component").agg(F.min(F.struct("doc_id", "fp", "text_hash", "n")).alias("best")).select("best.*"))
    dropped = alike.join(best, ["doc_id", "text_hash"], "left_anti").select(F.col("doc_id").alias("mr_id"), F.col("text_hash").alias("mr_hash"))

    def same_row(to: DataFrame) -> Column:
        return (docs[id_col].cast("long") == to["mr_id"]) & (_text_hash(docs, text_col) == to["mr_hash"])

    one = docs.join(dropped, same_row(dropped), "left_anti")
    repeated = best.filter("n > 1").select(F.col("doc_id").alias("mr_id"), F.col("text_hash").alias("mr_hash"))
    if repeated.isEmpty():
        return one
    # only rows with repeats are grouped
    several = docs.join(repeated, same_row(repeated)).dropDuplicates(["mr_id", "mr_hash"]).drop("mr_id", "mr_hash")
    return one.join(repeated, same_row(repeated), "left_anti").unionByName(several)
