"""Requirement rows: preparing extracted ones, resolving them again, boilerplate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import canonical_phrase, phrase_found
from millrace.operators.vocabulary import Vocabulary, only_token_within, rebound_version, resolved_with_hint
from millrace.settings import BOILERPLATE

MOST_ROWS = 40

#: What an extraction answers for one posting.
EXTRACTION = T.StructType([
    T.StructField("requirements", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("normalised_skill_hint", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("ordinal", T.IntegerType()),
    ]))),
    T.StructField("seniority_guess", T.StringType()),
    T.StructField("employment_type_guess", T.StringType()),
    T.StructField("notes", T.StringType()),
])

_KINDS = ("hard", "nice", "responsibility", "tool", "condition")


def valid_extraction(answer: Column) -> Column:
    """Whether an answer keeps to the schema's limits."""
    rows = answer["requirements"]
    good = F.forall(rows, lambda r: r["kind"].isin(*_KINDS) & F.length(r["text"]).between(2, 280) & (F.coalesce(F.length(r["normalised_skill_hint"]), F.lit(0)) <= 80) & r["weight"].between(0.25, 1.0))
    return answer.isNotNull() & (F.size(rows) <= MOST_ROWS) & good


def prepared(answers: DataFrame, vocabulary: Vocabulary, posting: str = "posting_id", answer: str = "answer") -> DataFrame:
    """Rows to store: of phrases with one key the first stays, ordinals are dense from 0."""
    rows = answers.select(posting, F.posexplode(F.col(f"{answer}.requirements")).alias("pos", "r")).select(posting, "pos", "r.kind", "r.text", "r.normalised_skill_hint", "r.weight")
    rows = rows.withColumn("_key", canonical_phrase(F.col("text"))).filter("_key <> ''")
    first = F.row_number().over(Window.partitionBy(posting, "_key").orderBy("pos"))
    rows = rows.withColumn("_first", first).filter("_first = 1")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(posting).orderBy("pos")) - 1)
    rows = resolved_with_hint(rows, vocabulary, "text", "normalised_skill_hint", "normalised_skill")
    weight = F.round(F.col("weight").cast("decimal(10,6)"), 2).cast("decimal(3,2)")
    return rows.select(posting, "kind", "text", "normalised_skill", "normalised_skill_hint", weight.alias("weight"), "ordinal")


def extraction_summary(answers: DataFrame, rows: DataFrame, posting: str = "posting_id") -> DataFrame:
    """postings, requirements, resolved, unresolved, empty_postings in one row."""
    per = rows.groupBy(posting).agg(F.count("*").alias("n"), F.count("normalised_skill").alias("ok"))
    joined = answers.select(posting).distinct().join(per, posting, "left")
    return joined.agg(
        F.count("*").alias("postings"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("requirements"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("resolved"),
        F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0)).alias("unresolved"),
        F.count_if(F.col("n").isNull()).alias("empty_postings"),
    )


def reresolved(rows: DataFrame, vocabulary: Vocabulary, containment: bool = False) -> DataFrame:
    """Rows with ``after``, ``version_after`` and ``outcome``.

    A row that would lose its token and kept no hint to recover it is left alone.
    """
    out = resolved_with_hint(rows, vocabulary, "text", "normalised_skill_hint", "_exact")
    within = only_token_within(F.when(F.col("_exact").isNull(), F.col("text")), vocabulary) if containment else F.lit(None).cast("string")
    out = out.withColumn("_within", within).withColumn("after", F.coalesce("_exact", "_within")).withColumn("version_after", rebound_version(F.col("prompt_version"), vocabulary))
    before, after = F.col("normalised_skill"), F.col("after")
    outcome = (
        F.when(after.isNull() & before.isNotNull() & F.col("normalised_skill_hint").isNull(), F.lit("unrecoverable"))
        .when(before.isNull() & after.isNotNull(), F.lit("gained"))
        .when(before.isNotNull() & after.isNull(), F.lit("lost"))
        .when(before != after, F.lit("changed"))
        .when(F.col("prompt_version") != F.col("version_after"), F.lit("rebound"))
        .otherwise(F.lit("same"))
    )
    return out.withColumn("outcome", outcome).withColumn("by_containment", F.col("_exact").isNull() & F.col("_within").isNotNull()).drop("_exact", "_within")


def reresolution_counts(rows: DataFrame) -> DataFrame:
    is_ = lambda *names: F.col("outcome").isin(*names)
    return rows.agg(
        F.count("*").alias("examined"),
        F.count_if(is_("gained")).alias("gained"),
        F.count_if(is_("lost")).alias("lost"),
        F.count_if(is_("changed")).alias("changed"),
        F.count_if(is_("unrecoverable")).alias("unrecoverable"),
        F.count_if(is_("gained") & F.col("by_containment")).alias("by_containment"),
        F.count_if(is_("gained", "lost", "changed", "rebound")).alias("rewritten"),
    )


def boilerplate_delta(rows: DataFrame, phrases: Sequence[str] = BOILERPLATE) -> DataFrame:
    """Unresolved hard rows that are conditions: all their columns, phrase, new kind."""
    unresolved = rows.filter((F.col("kind") == "hard") & F.col("normalised_skill").isNull())
    return unresolved.withColumn("phrase", phrase_found(F.col("text"), phrases)).filter("phrase is not null").withColumn("kind", F.lit("condition"))


def boilerplate_counts(texts: DataFrame, phrases: Sequence[str] = BOILERPLATE, column: str = "text") -> DataFrame:
    """phrase, n for each phrase, those that never occur included."""
    counted = texts.select(phrase_found(F.col(column), phrases).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    listed = texts.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string")
    return listed.join(counted, "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).alias("n"))


def unresolved_texts(rows: DataFrame) -> DataFrame:
    """text, n of hard requirements without a token."""
    return rows.filter((F.col("kind") == "hard") & F.col("normalised_skill").isNull()).groupBy("text").agg(F.count("*").alias("n"))


def replaced(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` with the rows of the keys in ``new`` replaced by ``new``."""
    # a task holds its distinct keys, which can't be skewed, and lets the stored rows pass unsorted
    gone = new.select(*keys).distinct().hint("shuffle_hash")
    return stored.join(gone, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
