"""Exact deduplication by owners in Patricia tries.

Texts are equal when their bytes are identical after deleting every ASCII white
space character.  Of equal texts the row with the most code points in the
original text stays, then the one with the smallest id (a null id is the
largest).  Rows that repeat an id together with its text count one by one, and
one of them stays.  A null text is empty, and all empty texts are equal.

Each map task inserts its normalised texts into a compressed radix trie, which
pre-aggregates copies: whatever the size of a group, a task hands on one row for
each different text.  Those rows are partitioned by length and content hash, and
each partition inserts the full byte strings into a trie of its own, whose
terminal nodes keep the smallest owner and the counts.  A trie that outgrows its
memory writes its heaviest subtree, or leaf, to an unnamed scratch file of the
task (at most the bytes of its partition), which is read back subtree by subtree;
nothing else ever reads that file, so a lost executor costs a rerun of the task
and no more.  The rows then find their owner
through the hash of their text, against groups of two or more only.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, checkpointed, slices, stateless

#: Bytes of text that one trie holds before it writes a subtree out.
TRIE_BYTES = 48 << 20

#: n_chars, doc_id, rows, rows that tie with the owner
Entry = tuple[int, "int | None", int, int]


def merged(one: Entry, other: Entry) -> Entry:
    """The better owner of two, with the counts of both."""
    rank = [(-x[0], x[1] is None, x[1] or 0) for x in (one, other)]
    if rank[0] == rank[1]:
        return one[0], one[1], one[2] + other[2], one[3] + other[3]
    best = one if rank[0] < rank[1] else other
    return best[0], best[1], one[2] + other[2], best[3]


def common_length(a: bytes, b: bytes, offset: int) -> int:
    """Length of the common prefix of ``a`` and ``b[offset:]``, by bisection."""
    low, high = 0, min(len(a), len(b) - offset)
    if a[:high] == b[offset : offset + high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[offset + low : offset + middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("label", "children", "entry", "spilled")

    def __init__(self, label: bytes, entry: Entry | None = None):
        self.label, self.entry = label, entry
        self.children: dict[int, Node] = {}
        self.spilled = None


class PatriciaTrie:
    """Compressed radix trie of byte strings with bounded memory."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.held, self.spills = Node(b""), limit, 0, 0

    def insert(self, key: bytes, entry: Entry) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                self._append(node.spilled, key[at:], entry)
                return
            if at == len(key):
                node.entry = merged(node.entry, entry) if node.entry else entry
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], entry)
                self.held += len(key) - at + 400
                break
            shared = common_length(child.label, key, at)
            if shared < len(child.label):
                middle = Node(child.label[:shared])
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.held += 400
                child = middle
            node, at = child, at + shared
        if self.held > self.limit:
            self._spill()

    def items(self) -> Iterator[tuple[bytes, Entry]]:
        """All strings with their entries, subtrees on disk included."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            path = above + node.label
            if node.spilled is not None:
                below = PatriciaTrie(self.limit)
                for key, entry in self._read(node.spilled):
                    below.insert(key, entry)
                node.spilled.close()
                for key, entry in below.items():
                    yield path + key, entry
                continue
            if node.entry:
                yield path, node.entry
            stack.extend((child, path) for child in node.children.values())

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 400
            stack.extend(x.children.values())
        return total

    def _spill(self) -> None:
        """Write out the heaviest subtree, or leaf, below the first branching node; its first byte stays.

        A single string that is longer than the bound is held as it is.
        """
        node = self.root
        while len(node.children) == 1 and not node.entry:
            node = next(iter(node.children.values()))
        weights = [(self._weight(child), byte) for byte, child in node.children.items() if child.spilled is None]
        if not weights:
            return
        child = node.children[max(weights)[1]]
        file = tempfile.TemporaryFile()
        stack = [(child, child.label[1:])]
        while stack:
            below, path = stack.pop()
            if below.spilled is not None:
                for key, entry in self._read(below.spilled):
                    self._append(file, path + key, entry)
                below.spilled.close()
            elif below.entry:
                self._append(file, path, below.entry)
            stack.extend((x, path + x.label) for x in below.children.values())
        child.label, child.children, child.entry, child.spilled = child.label[:1], {}, None, file
        self.held -= max(weights)[0]
        self.spills += 1

    @staticmethod
    def _append(file, key: bytes, entry: Entry) -> None:
        chars, doc_id, rows, ties = entry
        file.write(struct.pack("<q?qqqq", chars, doc_id is None, doc_id or 0, rows, ties, len(key)) + key)

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, Entry]]:
        size = struct.calcsize("<q?qqqq")
        file.seek(0)
        while head := file.read(size):
            chars, missing, doc_id, rows, ties, length = struct.unpack("<q?qqqq", head)
            yield file.read(length), (chars, None if missing else doc_id, rows, ties)
        file.seek(0, 2)


def _normalised(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """Code points of each text, and its bytes without white space."""
    for text in column.to_pylist():
        if text:
            yield len(text), text.encode("utf-8").translate(None, SPACES)
        else:
            yield 0, b""


def _local_owners(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit)
        for batch in batches:
            for part in slices(batch):
                for doc_id, (chars, content) in zip(part.column(0).to_pylist(), _normalised(part.column(1))):
                    trie.insert(content, (chars, doc_id, 1, 1))
                    if trie.spills:  # hand on instead of writing out: owners can meet later as well
                        yield from _entry_batches(trie)
                        trie = PatriciaTrie(limit)
        yield from _entry_batches(trie)

    return run


def _entry_batches(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for content, entry in trie.items():
        rows.append((len(content), xxhash.xxh64_intdigest(content) - (1 << 63), content, *entry))
        held += len(content)
        if held > 4 << 20 or len(rows) >= 4096:
            yield _entry_batch(rows)
            rows, held = [], 0
    yield _entry_batch(rows)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["n_bytes", "content_hash", "content", "best_chars", "best_id", "n_rows", "n_ties"])


def _owners(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit)
        for batch in batches:
            for part in slices(batch):
                for content, *entry in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
                    trie.insert(content, tuple(entry))
        rows = []
        for content, (chars, doc_id, n_rows, n_ties) in trie.items():
            if n_rows > 1:
                rows.append((hashlib.sha256(content).digest(), chars, doc_id, n_rows, n_ties))
            if len(rows) >= 4096:
                yield _owner_batch(rows)
                rows = []
        yield _owner_batch(rows)

    return run


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["owner_hash", "best_chars", "best_id", "n_rows", "n_ties"])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Groups of two or more equal texts: owner_hash, best_chars, best_id, n_rows, n_ties."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    partial = rows.mapInArrow(stateless(_local_owners(trie_bytes)), "n_bytes long, content_hash long, content binary, best_chars long, best_id long, n_rows long, n_ties long")
    return partial.repartition("n_bytes", "content_hash").mapInArrow(stateless(_owners(trie_bytes)), "owner_hash binary, best_chars long, best_id long, n_rows long, n_ties long")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the normalised text and the code points after the columns."""
    for batch in batches:
        for part in slices(batch):
            chars, hashes = [], []
            for n, content in _normalised(part.column(1)):
                chars.append(n)
                hashes.append(hashlib.sha256(content).digest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary()), pa.array(chars, pa.int64()), *(part.column(i) for i in range(2, part.num_columns))], ["mr_id", "mr_hash", "mr_chars", *part.schema.names[2:]])


def _matched(hashed: DataFrame, groups: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with their group where there is one, and whether a row is its best."""
    joined = hashed.join(groups, hashed["mr_hash"] == groups["owner_hash"], "left")
    best = F.col("owner_hash").isNull() | (F.col("mr_id").eqNullSafe(F.col("best_id")) & (F.col("mr_chars") == F.col("best_chars")))
    return joined, best


def _one_of_ties(joined: DataFrame, best: Column, groups: DataFrame, flag: str) -> DataFrame:
    """Flags rows that stay; of several best rows (repeated rows) just one.

    Only groups with such ties pass through the window, and they hold rows with
    the same id and text.  Where no group has any, the rows are read once.
    """
    if groups.filter("n_ties > 1").isEmpty():
        return joined.withColumn(flag, best)
    tied = F.coalesce(F.col("n_ties"), F.lit(1)) > 1
    single = joined.filter(~(tied & best)).withColumn(flag, best)
    order = Window.partitionBy("mr_hash").orderBy(F.col("mr_id"))
    several = joined.filter(tied & best).withColumn(flag, F.row_number().over(order) == 1)
    return single.unionByName(several)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(docs[id_col].cast("long").alias("mr_id"), docs[text_col].cast("string").alias("mr_text"))
    hashed = rows.mapInArrow(stateless(_hashed), "mr_id long, mr_hash binary, mr_chars long")
    groups = checkpointed(owners(docs, id_col, text_col, trie_bytes))
    joined, best = _matched(hashed, groups)
    return _one_of_ties(joined, best, groups, "kept").select(
        F.col("mr_id").alias("doc_id"),
        F.when(F.col("owner_hash").isNull(), F.col("mr_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce(F.col("n_rows"), F.lit(1).cast("long")).alias("group_size"),
        "kept",
        F.lower(F.hex("mr_hash")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    carried = docs.select(docs[id_col].cast("long").alias("mr_id"), docs[text_col].cast("string").alias("mr_text"), *(docs[c].alias(f"mr_c{i}") for i, c in enumerate(names)))
    fields = ", ".join(f"mr_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    hashed = carried.mapInArrow(stateless(_hashed), f"mr_id long, mr_hash binary, mr_chars long, {fields}")
    groups = checkpointed(owners(docs, id_col, text_col, trie_bytes))
    joined, best = _matched(hashed, groups)
    return _one_of_ties(joined, best, groups, "mr_kept").filter("mr_kept").select(*(F.col(f"mr_c{i}").alias(c) for i, c in enumerate(names)))
