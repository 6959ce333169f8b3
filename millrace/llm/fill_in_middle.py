"""Fill-in-middle transformation over an index of the different texts.

A text is a sequence of units: runs of ASCII letters, and single other code
points.  Each document draws two cuts between units from the hash of its seed and
id, and is rearranged so that the piece between the cuts comes last:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text itself

Where the units of a text end does not depend on the document, so identical texts
share one index entry.  Texts are grouped by SHA-256; that the rows of a group
have one content is verified on the texts themselves (the set of a group's texts
has one element, else the query fails).  Documents join the groups by the digest alone,
and where a group begins its entry is computed, once: the ends as an Elias-Fano
list, some four bits a unit, with every ``SAMPLE``-th place of its upper half, so
that one end is read without decoding the others.  Each document of the group
selects the two ends of its cut there.

Each task hands on one row per different text, whatever the number of its copies,
and texts move through one shuffle: entries are made behind the join, since what
Python adds ahead of it would have to be dealt once more, texts included.  A text
that more than ``share`` documents have (``HOT_ROWS``, and one ``SHARES``-th of all
documents where that is more) is copied for each ``share`` of its documents, with
an entry for each copy, so no task meets more of them; there are at most
``SHARES`` such texts.

Null texts are empty.  A null id is hashed as if it had no digits.  Repeated rows
and ids each give a row.  Empty texts, and texts that hold a marker themselves,
stay plain.  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import checkpointed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Ones of the upper half of an Elias-Fano list between two sampled places.
SAMPLE = 256
#: Documents of one text from which on it is copied, and parts of the corpus that a copy serves at most.
HOT_ROWS, SHARES = 64, 4096
#: Per cent of the documents that stay plain, and of the others that are written suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


def unit_ends(text: str) -> np.ndarray:
    """Code points before the end of each unit, ascending; the last is the length."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) - 97 < 26) & (points < 128)
    inside = letter[:-1] & letter[1:]
    return np.append(np.flatnonzero(~inside) + 1, len(points)) if len(points) else np.empty(0, np.int64)


class EliasFano:
    """Ascending whole numbers, the last being their bound, in 2 + log2(bound / n) bits each.

    Lower bits stand packed side by side; the upper ones are a bit string in which
    the i-th one (from 0) at place p says that number i is (p - i) above.
    """

    HEAD = np.dtype([("n", "<u8"), ("bound", "<u8")])

    def __init__(self, code: bytes):
        self.n, self.bound = (int(x) for x in np.frombuffer(code, self.HEAD, 1)[0])
        self.width, low, high, samples = self._layout(self.n, self.bound)
        at = self.HEAD.itemsize
        self.low = np.frombuffer(code, np.uint8, low, at)
        self.high = np.frombuffer(code, np.uint8, high, at + low)
        self.samples = np.frombuffer(code, "<u8", samples, at + low + high)

    @staticmethod
    def _layout(n: int, bound: int) -> tuple[int, int, int, int]:
        """Lower bits of a number, and the sizes of the three parts: bytes, bytes, samples."""
        width = max(0, (bound // n).bit_length() - 1) if n else 0
        return width, -(-n * width // 8), -(-(n + (bound >> width) + 1) // 8) if n else 0, -(-n // SAMPLE)

    @classmethod
    def encoded(cls, numbers: np.ndarray) -> bytes:
        n, bound = len(numbers), int(numbers[-1]) if len(numbers) else 0
        width, _, high_bytes, _ = cls._layout(n, bound)
        numbers = numbers.astype(np.uint64)
        lower = (numbers[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        places = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
        upper = np.zeros(high_bytes * 8, np.uint8)
        upper[places] = 1
        parts = [np.array([(n, bound)], cls.HEAD), np.packbits(lower.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), places[::SAMPLE].astype("<u8")]
        return b"".join(part.tobytes() for part in parts)

    def select(self, i: int) -> int:
        """Number ``i``, from a sampled place and the bits after it."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        left += int(bits[: place & 7].sum())
        while True:
            ones = np.flatnonzero(bits)
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                break
            left -= len(ones)
            byte += 64
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        first = i * self.width
        low = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3].tobytes(), "little") >> (first & 7)
        return (place - i) << self.width | low & ((1 << self.width) - 1)

    def before(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        return self.select(units - 1) if units else 0


_CUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


@F.arrow_udf(_CUT)
def _cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """(digest, text, h1 to h4), by digest, to the cut and the output; the documents of one text share its entry."""
    indexed, ends = None, None
    for columns in batches:
        out = []
        for digest, text, *drawn in zip(*columns):
            digest, text = digest.as_py(), text.as_py()
            h1, h2, h3, h4 = (x.as_py() for x in drawn)
            if digest != indexed:
                indexed, ends = digest, EliasFano(EliasFano.encoded(unit_ends(text)))
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
                out.append((ends.n, "plain", None, None, text))
                continue
            first, last = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
            a, b = ends.before(first), ends.before(last)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < SUFFIX_FIRST:
                out.append((ends.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
            else:
                out.append((ends.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.StructArray.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * 5, kinds)], _CUT.fieldNames())


def different_texts(rows: DataFrame) -> DataFrame:
    """(digest, text) rows to one row per different text: own, text; fails where texts of one digest differ."""
    one = rows.groupBy(F.col("digest").alias("own")).agg(F.collect_set("text").alias("texts"))
    verified = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("string"))
    return one.select("own", verified.alias("text"))


def transformed(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = checkpointed(rows.select("doc_id", "digest"))
    share = max(hot_rows, -(-keyed.count() // SHARES))
    # more than share rows each, so at most SHARES of them
    hot = checkpointed(keyed.groupBy("digest").agg(F.count("*").alias("copies")).filter(F.col("copies") > share).select(F.col("digest").alias("hot_digest"), F.ceil(F.col("copies") / share).alias("parts")))
    is_hot = F.col("digest") == F.col("hot_digest")
    # both sides are dealt and sorted by digest, so the documents of a text follow one another
    texts = different_texts(rows.join(F.broadcast(hot), is_hot, "left_anti"))
    found = keyed.join(F.broadcast(hot), is_hot, "left_anti").join(texts.hint("merge"), F.col("digest") == F.col("own")).select("doc_id", "digest", "text")
    if hot.count():
        texts = checkpointed(different_texts(rows.join(F.broadcast(hot), is_hot, "left_semi")))
        copies = texts.join(F.broadcast(hot), F.col("own") == F.col("hot_digest")).select("own", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("own_part"))
        # the place of a row in the written table deals it, so that ids may repeat or be null
        dealt = keyed.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), is_hot).select("doc_id", "digest", F.pmod(F.xxhash64("place"), F.col("parts")).alias("part"))
        found = found.unionByName(dealt.join(copies.hint("merge"), (F.col("digest") == F.col("own")) & (F.col("part") == F.col("own_part"))).select("doc_id", "digest", "text"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return found.select("doc_id", _cut("digest", "text", *numbers).alias("cut")).select("doc_id", "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after the leading marker, after ``second`` and after the middle's marker."""
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(output))

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns; the restored text comes from what was written."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
