"""What-if reports on the screening rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import first_match, whole_word
from millrace.operators.screen import role_markers
from millrace.settings import DEFAULT, Settings

# What marks an engineering title, for collateral counts.
ENGINEERING = r"(?i)\b(engineer|developer|scientist|architect|programmer|sre|devops)\b"


def marker_histogram(postings: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """hits, n, at_least: postings by number of markers, and how many a threshold would remove."""
    counts = postings.select(F.size(role_markers(settings)).alias("hits")).groupBy("hits").agg(F.count("*").alias("n"))
    # as many rows as there are markers
    return counts.withColumn("at_least", F.sum("n").over(Window.orderBy(F.desc("hits"))))


def near_misses(postings: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Postings one marker short of rejection."""
    rows = postings.withColumn("hits", role_markers(settings))
    return rows.filter(F.size("hits") == settings.role_marker_min - 1)


def survivors(judged: DataFrame, least: int = 1) -> DataFrame:
    """company_id, title, n of the postings that pass."""
    return judged.filter("reason is null").groupBy("company_id", "title").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def tried_words(titles: DataFrame, words: Sequence[str], samples: int = 3) -> DataFrame:
    """word, n, engineering, examples: what each candidate for the deny list would remove."""
    lowered = F.lower("title")
    hits = F.array_compact(F.array(*(F.when(lowered.rlike(whole_word(w.lower())), F.lit(w)) for w in words)))
    rows = titles.select("title", F.col("title").rlike(ENGINEERING).alias("eng"), F.explode(hits).alias("word"))
    first = F.row_number().over(Window.partitionBy("word").orderBy("title"))
    counts = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if("eng").alias("engineering"))
    examples = rows.select("word", "title").distinct().withColumn("r", first).filter(F.col("r") <= samples).groupBy("word").agg(F.array_sort(F.collect_list("title")).alias("examples"))
    return counts.join(examples, "word")


def title_buckets(titles: DataFrame, patterns: Sequence[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    """bucket, n by the first pattern that a title matches."""
    return titles.groupBy(first_match(F.col("title"), patterns, otherwise).alias("bucket")).agg(F.count("*").alias("n"))


def years_histogram(postings: DataFrame, column: str = "required_years") -> DataFrame:
    """years, n, above: postings by years asked for, and what a ceiling below them would remove."""
    counts = postings.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("years")).agg(F.count("*").alias("n"))
    return counts.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("years"))))


def resolution_rates(requirements: DataFrame) -> DataFrame:
    """kind, n, resolved, share."""
    sums = requirements.groupBy("kind").agg(F.count("*").alias("n"), F.count("normalised_skill").alias("resolved"))
    return sums.withColumn("share", F.col("resolved") / F.col("n"))


def top_skills(requirements: DataFrame, most: int) -> DataFrame:
    counts = requirements.filter("normalised_skill is not null").groupBy("normalised_skill").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "normalised_skill").limit(most)


def postings_by_version(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("prompt_version").agg(F.countDistinct("posting_id").alias("postings"))


def newest_per_company(postings: DataFrame, most: int | None = None) -> DataFrame:
    """One open, visible posting with a real text for each company: the newest."""
    rows = postings.filter(F.col("closed_at").isNull() & ~F.col("filtered_out") & (F.length("description_text") > 200))
    order = Window.partitionBy("company_id").orderBy(F.desc("first_seen_at"), "id")
    rows = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return rows if most is None else rows.orderBy("company_id").limit(most)


def slice_candidates(postings: DataFrame, hints: Sequence[str] = (), fewest: int | None = None, most_words: int | None = None) -> DataFrame:
    """Candidates of a golden slice: title hints and length bands, one per company."""
    from millrace.functions.text import any_of, word_count

    words = word_count(F.col("description_text"))
    rows = postings
    if most_words is not None:
        rows = rows.filter(words <= most_words)
    if fewest is not None:
        rows = rows.filter(words >= fewest)
    if hints:
        rows = rows.filter(any_of([F.contains(F.lower("title"), F.lit(h)) for h in hints]))
    return newest_per_company(rows)
