"""Keyword search over stored posting lists.

The index is a keyed table with a row for each word and block of ids: the ids that
have the word as offsets within the block, and how often.  A frequent word is as many
rows as there are blocks, and no list is longer than a block.  Rows are bucketed by
word, so a search opens the buckets of its words and reads their rows alone; texts
are not read again.  A row of its own says which texts a block has and how long each
is.  When texts change, the blocks they are in are listed anew; a list that is older
than its block's row is of a word that left the block, and counts no more.

Texts are shuffled once, by block, and what a task sends on are whole lists.

Results are ranked by BM25.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.keyed import KeyedTable

#: A block is this many ids, a power of two.
BLOCK = 1 << (BITS := 10)
#: Parameters of the ranking.
K1, B = 1.2, 0.75
#: The row of a block that lists its texts with their numbers of words; no text has such a word.
TOTALS = ""
_LISTS = "word string, block long, offsets array<int>, counts array<int>"


def words(text: Column) -> Column:
    """The words of a text, lower-cased, with repeats, one a line."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "\n")


def _places(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Word and offset of every word of a block's texts, and the number of words by offset."""
    found, places, lengths = [], [], np.zeros(BLOCK, dtype=np.int64)
    for batch in block.to_batches():
        offsets = batch["offset"].to_numpy(zero_copy_only=False).astype(np.int64)
        lines = pc.split_pattern(batch["words"], "\n")
        flat, at = lines.flatten(), offsets[pc.list_parent_indices(lines).to_numpy()]
        some = pc.not_equal(flat, "")
        found.append(flat.filter(some))
        places.append(at[some.to_numpy(zero_copy_only=False)])
        lengths += np.bincount(places[-1], minlength=BLOCK)
    return pa.chunked_array(found, pa.string()), np.concatenate([*places, np.zeros(0, np.int64)]), lengths


def _inverted(key: tuple, block: pa.Table) -> pa.Table:
    """The lists of one block."""
    block = block.filter(pc.is_valid(block["offset"]))
    texts = np.unique(block["offset"].to_numpy())
    flat, places, lengths = _places(block)
    codes = flat.dictionary_encode().combine_chunks() if flat.num_chunks else pa.array([], pa.string()).dictionary_encode()
    pairs, counts = np.unique(codes.indices.to_numpy().astype(np.int64) << BITS | places, return_counts=True)
    code = pairs >> BITS
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    bounds = pa.array(np.concatenate([starts, [len(pairs), len(pairs) + len(texts)]]), pa.int32())
    listed = lambda own, of_texts: pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([own, of_texts]), pa.int32()))
    return pa.table({
        "word": pa.concat_arrays([codes.dictionary.take(pa.array(code[starts])), pa.array([TOTALS], pa.string())]),
        "block": pa.array(np.full(len(starts) + 1, key[0].as_py()), pa.int64()),
        "offsets": listed(pairs & (BLOCK - 1), texts),
        "counts": listed(counts, lengths[texts]),
    })


def lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: DataFrame | None = None) -> DataFrame:
    """Posting lists of (id, text) rows: word, block, offsets, counts.  Ids are whole numbers, each once; null texts have no words.

    With ``blocks``, the lists of those only, and of each at least the row of its texts.
    """
    id = docs[id_col].cast("long")
    rows = docs.select(F.shiftright(id, BITS).alias("block"), F.pmod(id, F.lit(BLOCK)).cast("int").alias("offset"), words(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("words"))
    if blocks is not None:
        # the side of the texts is dealt by block as the lists need it
        rows = rows.join(blocks.hint("shuffle_hash"), "block", "right")
    return rows.groupBy("block").applyInArrow(_inverted, _LISTS)


def build(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> KeyedTable:
    """A new index of ``docs`` at ``path``."""
    listed = lists(docs, id_col, text_col)
    table = KeyedTable.create(spark, path, listed.schema, ["word", "block"], buckets=buckets, by=["word"])
    table.upsert(listed)
    return table


def update(index: KeyedTable, docs: DataFrame, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Lists anew the blocks of the ``changed`` ids, from ``docs`` as they are now."""
    blocks = changed.select(F.shiftright(changed[id_col].cast("long"), BITS).alias("block")).distinct()
    index.upsert(lists(docs, id_col, text_col, blocks))


def _read(index: KeyedTable, wanted: Sequence[str]) -> DataFrame:
    """The lists of some words: their buckets only, and of those their rows only."""
    now = index.manifest()
    named = index.spark.createDataFrame([(w,) for w in wanted], "word string")
    buckets = [row[0] for row in named.select(index.bucket_of(now)).distinct().collect()]
    # ahead of the merge, where the scan takes the filter
    return index.read(buckets, F.col("word").isin(*wanted), versions=True)


def found(index: KeyedTable, search: str) -> DataFrame:
    """id, score of the texts that have all words of a search."""
    wanted = sorted({w for w in re.split(r"\W+", search.lower()) if w})
    rows = _read(index, [*wanted, TOTALS])
    if not wanted:
        return rows.limit(0).select(F.col("block").alias("id"), F.lit(0.0).alias("score"))
    totals = rows.filter(F.col("word") == TOTALS).select("block", F.col("offsets").alias("texts"), F.col("counts").alias("lengths"), F.col("_version").alias("listed"))
    size = totals.agg(F.sum(F.size("texts")).alias("n_texts"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("all_words"))
    # a list that its block's last listing didn't write is of a word that is there no more
    own = rows.filter(F.col("word") != TOTALS).join(totals.select("block", "listed"), "block").filter(F.col("_version") >= F.col("listed")).select("word", "block", "offsets", "counts")
    holding = own.groupBy("word").agg(F.sum(F.size("offsets")).alias("df"))
    # blocks in which every word occurs; within them the offsets that all lists share
    entries = F.transform("offsets", lambda offset, i: F.struct(offset.alias("offset"), F.get("counts", i).alias("count")))
    met = own.groupBy("block").agg(F.collect_list(F.struct("word", "offsets", entries.alias("entries"))).alias("by_word")).filter(F.size("by_word") == len(wanted))
    shared = F.aggregate(F.col("by_word"), F.get(F.col("by_word"), F.lit(0))["offsets"], lambda kept, one: F.array_intersect(kept, one["offsets"]))
    hits = met.withColumn("shared", shared).filter(F.size("shared") > 0).join(totals.select("block", "texts", "lengths"), "block").select("block", "shared", "texts", "lengths", F.explode("by_word").alias("one"))
    hits = hits.select("block", "shared", "texts", "lengths", F.col("one.word").alias("word"), F.explode("one.entries").alias("e")).filter(F.array_contains("shared", F.col("e.offset")))
    hits = hits.select("block", "word", "e", F.get("lengths", F.array_position("texts", F.col("e.offset")).cast("int") - 1).alias("length"))
    scored = hits.join(F.broadcast(holding), "word").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("e.count") + K1 * (1 - B + B * F.col("length") / (F.col("all_words") / F.col("n_texts")))
    part = idf * F.col("e.count") * (K1 + 1) / norm
    return scored.select((F.col("block") * BLOCK + F.col("e.offset")).alias("id"), part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))


def best(index: KeyedTable, search: str, most: int = 20) -> DataFrame:
    """The best matches, by score, then id."""
    return found(index, search).orderBy(F.desc("score"), "id").limit(most)
