"""A training-corpus pipeline over ``documents``: filter, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents; the rows a stage leaves out are gone for the
stages after it.  Null texts count as empty, extra columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, mixing, quality, simhash
from millrace.llm.common import delete_path, path_exists, read_table, shared_folder, small_batches
from millrace.llm.queries import tokenizer_path, tokenizer_pattern


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, fitted on the labelled ones among them."""
    return quality.accepted(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    small_batches(spark)
    return mixing.repeated(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids (little-endian, 32 bits)."""
    # by this stage the executors' heaps are full-grown: smaller caches leave them room
    return bpe.round_trip(docs, tokenizer_path(), tokenizer_pattern(), max_states=80_000, max_pieces=160_000, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("source mixing", source_mix),
    ("byte-level BPE", tokenised),
]

#: The classifier and the mixing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents.

    A run that has failed goes on behind its last finished stage if it is started
    again with the same ``run_id``; without one every run starts anew.
    """
    docs = read_table(small_batches(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    done = [k for k in range(len(STAGES)) if path_exists(spark, f"{folder}/{k}/_SUCCESS")]
    first = done[-1] + 1 if done else 0
    if first:
        docs = spark.read.parquet(f"{folder}/{first - 1}")
    for k, (_, function) in enumerate(STAGES[first:], first):
        path = f"{folder}/{k}"
        function(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_path(spark, f"{folder}/{k - 1}")
    return docs
