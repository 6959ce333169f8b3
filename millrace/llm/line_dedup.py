"""Line deduplication by pairwise alignment.

Documents overlap when they share lines.  Lines of ``min_words`` words or more
are hashed (128 bits, surrounding white space cut).  A rare one, in at most ``rare``
documents, pairs each of them with every earlier one.  A frequent one pairs each
document with the first that has it, and with the first that has it beside the same
line before or after, so that what stands around it is met too; that makes at most
three pairs for each place, never the square of a line's frequency.  Pairs of one
first document are dealt to ``SALTS`` tasks, each with a copy of its line hashes.

Each pair is aligned by patience diff over the line hashes: lines unique in both
sides are anchors, their longest increasing subsequence is kept, and the stretches
between are aligned alike.  Long lines that this leaves, since their order is crossed
or they repeat, are dealt into piles as in patience, each pile being an alignment in
order of its own.  Common blocks (runs of aligned lines with at least one line of
``min_words`` words) are deleted from the later document, the one with the larger
id; the earlier keeps them.  Nothing is deleted that was not aligned.

Documents are told apart by id.  Rows with a null id neither lose lines nor take
any from others.  Rows that repeat an id are one document for the comparison, and
a deletion applies to the rows whose line at that place has that hash.  Null and
empty texts have one empty line.  Documents whose lines all go keep an empty
text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, slices, stateless, texts

MIN_WORDS = 5
#: Parts into which the later documents of one first document are dealt.
SALTS = 256
#: Documents that a line is in at most to pair all of them; of other lines the first holders stand for all.
RARE = 8


def line_keys(text: str, min_words: int = MIN_WORDS) -> list[bytes]:
    """A key per line: 16 bytes where the line has ``min_words`` words, else 8."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        content = line.encode("utf-8")
        out.append(xxhash.xxh3_128_digest(content) if len(line.split(None, min_words)) >= min_words else xxhash.xxh3_64_digest(content))
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs sorted by their first that also rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _in_order(a: Sequence[bytes], b: Sequence[bytes]) -> list[tuple[int, int]]:
    """Patience diff: lines unique in both sides anchor, in longest rising order; the stretches between are aligned alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {key: j for j, key in enumerate(b[b0:b1], b0) if in_b[key] == 1}
        anchors = _increasing([(i, place[key]) for i, key in enumerate(a[a0:a1], a0) if in_a[key] == 1 and key in place])
        out.extend(anchors)
        left = (a0, b0)
        for i, j in [*anchors, (a1, b1)] if anchors else ():
            if i > left[0] and j > left[1]:
                todo.append((left[0], i, left[1], j))
            left = (i + 1, j + 1)
    return sorted(out)


def _piles(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs, rising in their second, dealt into as few alignments as can be: each goes behind the nearest smaller first, as cards are dealt in patience."""
    tops: list[int] = []  # negated firsts of the last pairs, ascending
    out: list[list[tuple[int, int]]] = []
    for i, j in pairs:
        at = bisect_right(tops, -i)
        if at == len(tops):
            tops.append(-i)
            out.append([(i, j)])
        else:
            tops[at] = -i
            out[at].append((i, j))
    return out


def patience(a: Sequence[bytes], b: Sequence[bytes]) -> list[list[tuple[int, int]]]:
    """Alignments of two sequences: that of the patience diff, then those of the long lines whose order is crossed or that repeat.

    A long line of ``b`` that the diff leaves is paired with the place behind its
    predecessor's, or else with the occurrence in ``a`` of the same number, or the last.
    """
    first = _in_order(a, b)
    places: dict[bytes, list[int]] = {}
    for i, key in enumerate(a):
        if len(key) == 16:
            places.setdefault(key, []).append(i)
    paired = {j: i for i, j in first}
    seen: Counter = Counter()
    rest = []
    for j, key in enumerate(b):
        if len(key) != 16 or key not in places:
            continue
        number = seen[key]
        seen[key] += 1
        if j in paired:
            continue
        behind = paired.get(j - 1, -2) + 1
        i = behind if 0 <= behind < len(a) and a[behind] == key else places[key][min(number, len(places[key]) - 1)]
        paired[j] = i
        rest.append((i, j))
    return [first, *_piles(rest)]


def common_blocks(a: Sequence[bytes], b: Sequence[bytes]) -> list[tuple[int, int]]:
    """(start, length) in ``b`` of the aligned blocks that have a line of enough words, in order.

    A block of a later alignment takes the equal lines around it, as far as no earlier
    block has them.
    """
    blocks: list[tuple[int, int]] = []
    gone: set[int] = set()
    for alignment in patience(a, b):
        run: list[tuple[int, int]] = []
        for i, j in [*alignment, (-1, -1)]:
            if run and (i, j) == (run[-1][0] + 1, run[-1][1] + 1):
                run.append((i, j))
                continue
            if any(len(b[y]) == 16 for _, y in run):
                (x, start), end = run[0], run[-1][1] + 1
                while start and start - 1 not in gone and x and a[x - 1] == b[start - 1]:
                    x, start = x - 1, start - 1
                x = run[-1][0] + 1
                while end < len(b) and end not in gone and x < len(a) and a[x] == b[end]:
                    x, end = x + 1, end + 1
                new = [y for y in range(start, end) if y not in gone]
                gone.update(new)
                blocks.extend((y, 1) for y in new)
            run = [(i, j)]
    return _joined(blocks)


def _joined(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent blocks as one."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(blocks):
        if out and sum(out[-1]) == start:
            out[-1] = (out[-1][0], out[-1][1] + length)
        else:
            out.append((start, length))
    return out


def _hash(*parts: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"|".join(parts)) - (1 << 63)


def neighbourhoods(keys: Sequence[bytes]) -> list[dict]:
    """Each different long line of a document with the hashes of the pairs that it makes with its neighbours there."""
    found: dict[bytes, set[int]] = {}
    for j, key in enumerate(keys):
        if len(key) == 16:
            pairs = found.setdefault(key, set())
            if j:
                pairs.add(_hash(keys[j - 1], key))
            if j + 1 < len(keys):
                pairs.add(_hash(key, keys[j + 1]))
    return [{"key": key, "pairs": sorted(pairs)} for key, pairs in found.items()]


def _sequences(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = [line_keys(text, min_words) for text in texts(part.column(1))]
                lines = pa.array([neighbourhoods(k) for k in keys], pa.list_(pa.struct([("key", pa.binary()), ("pairs", pa.list_(pa.int64()))])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.binary())), lines], ["doc_id", "keys", "lines"])

    return run


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, first_keys, keys) to the places and hashes of the lines to delete."""
    for batch in batches:
        for part in slices(batch, 256):
            ids, places, hashes = [], [], []
            for doc_id, first, keys in zip(*(part.column(i).to_pylist() for i in range(3))):
                for start, length in common_blocks(first, keys):
                    for j in range(start, start + length):
                        ids.append(doc_id)
                        places.append(j)
                        hashes.append(_short(keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64())], ["doc_id", "place", "hash"])


_PLACES = "doc_id long, place int, hash long"


def _met(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id, key) rows to doc_id, first: the smallest id of each key with every other that has it."""
    # written, so that the join deals both sides anew and a very common key can be split
    owners = checkpointed(rows.groupBy(F.col(key).alias("owner")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"))
    return rows.join(owners, F.col(key) == F.col("owner")).filter("doc_id > first").select("doc_id", "first")


def partners(sequences: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_id, first: each document with the earlier ones that it is compared with, once."""
    lines = sequences.select("doc_id", F.explode("lines").alias("line")).select("doc_id", "line.key", "line.pairs")
    owners = checkpointed(lines.groupBy(F.col("key").alias("owner")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1"))
    shared = checkpointed(lines.join(owners, F.col("key") == F.col("owner")).select("doc_id", "key", "pairs", "n", "least"))
    # at most ``rare`` holders a line, so lists and pairs are bounded
    holders = shared.filter(F.col("n") <= rare).groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select("ids", F.posexplode("ids").alias("at", "doc_id"))
    among = holders.select("doc_id", F.explode(F.slice("ids", F.lit(1), F.col("at"))).alias("first")).filter("first < doc_id")
    frequent = shared.filter(F.col("n") > rare)
    to_first = frequent.filter("doc_id > least").select("doc_id", F.col("least").alias("first"))
    beside = _met(frequent.select("doc_id", F.explode("pairs").alias("pair")), "pair")
    return among.unionByName(to_first).unionByName(beside).distinct()


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, lines (array of struct place, hash): what each later document loses."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("doc_id is not null")
    sequences = checkpointed(rows.mapInArrow(stateless(_sequences(min_words)), "doc_id long, keys array<binary>, lines array<struct<key:binary,pairs:array<bigint>>>"))
    pairs = checkpointed(partners(sequences, rare).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    firsts = sequences.select(F.col("doc_id").alias("first_id"), F.col("keys").alias("first_keys"))
    mine = sequences.select(F.col("doc_id").alias("own_id"), "keys")
    # one copy of the first document for each of its salts, so that a very common one is spread
    wanted = pairs.select(F.col("first").alias("wanted_id"), F.col("salt").alias("wanted_salt")).distinct()
    copies = wanted.join(firsts, F.col("wanted_id") == F.col("first_id")).select("wanted_id", "wanted_salt", "first_keys")
    aligned = pairs.join(copies, (F.col("first") == F.col("wanted_id")) & (F.col("salt") == F.col("wanted_salt"))).join(mine, F.col("doc_id") == F.col("own_id")).select("doc_id", "first_keys", "keys").mapInArrow(stateless(_align), _PLACES)
    return aligned.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "hash"))).alias("lines"))


def _apply(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, deleted, kept = [], [], []
                for text, gone in zip(texts(part.column(1)), part.column(2).to_pylist()):
                    lines = text.split("\n")
                    places: list[int] = []
                    if gone:
                        keys = line_keys(text, min_words)
                        places = [x["place"] for x in gone if x["place"] < len(keys) and _short(keys[x["place"]]) == x["hash"]]
                        drop = set(places)
                        text = "\n".join(line for j, line in enumerate(lines) if j not in drop)
                    counts.append(len(lines))
                    deleted.append(places)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int32()), pa.array(deleted, pa.list_(pa.int32())), pa.array(kept, pa.string())], ["doc_id", "n_lines", "deleted_lines", "text"])

    return run


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, deleted_lines (from 0), text without them."""
    gone = deletions(docs, id_col, text_col, min_words, rare).withColumnRenamed("doc_id", "gone_id")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    joined = rows.join(gone, F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "lines")
    return joined.mapInArrow(stateless(_apply(min_words)), "doc_id long, n_lines int, deleted_lines array<int>, text string")
