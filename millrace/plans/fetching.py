"""What a downloader's log says: retries, breakers, waits, repairs; one row per attempt.

The downloader itself stands in front of the landing folder.  Its rules are
evaluated here over the log it leaves, in windows of one bucket (a host or
tenant) within one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses worth another attempt, and how many attempts there are.
RETRYABLE_STATUSES = (408, 425, 429, 500, 502, 503, 504)
MOST_ATTEMPTS = 4


def retryable(status: Column) -> Column:
    """Whether an attempt may be repeated; no status is a failure of the transport."""
    return status.isNull() | status.isin(*RETRYABLE_STATUSES)


def requests(attempts: DataFrame, by: tuple[str, ...] = ("run_id", "bucket"), most: int = MOST_ATTEMPTS) -> DataFrame:
    """One row per request: its number of attempts, retries, last status, and ok or exhausted or refused.

    ``attempts``: ``by``, request, attempt (from 0), status.
    """
    last = F.max_by("status", "attempt")
    rows = attempts.groupBy(*by, "request").agg(F.count("*").alias("attempts"), last.alias("status"))
    outcome = F.when(F.col("status").between(200, 299), "ok").when(retryable(F.col("status")) & (F.col("attempts") >= most), "exhausted").when(retryable(F.col("status")), "given_up").otherwise("refused")
    return rows.withColumn("retries", F.col("attempts") - 1).withColumn("outcome", outcome)


def breaker(finished: DataFrame, threshold: int, by: tuple[str, ...] = ("run_id", "bucket"), order: str = "request") -> DataFrame:
    """``finished`` with ``failures`` in a row so far and ``short_circuited``: the breaker was open before it.

    Only failures of the transport or the server count; a success starts anew, and
    what is open stays open for the run.
    """
    own = Window.partitionBy(*by).orderBy(order)
    failed = F.col("status").isNull() | (F.col("status") >= 500)
    # rows since the last success are one streak
    streak = F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = finished.withColumn("_failed", failed).withColumn("_streak", streak)
    in_streak = Window.partitionBy(*by, "_streak").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("failures", F.sum(F.col("_failed").cast("int")).over(in_streak))
    before = F.max("failures").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("short_circuited", F.coalesce(before >= threshold, F.lit(False))).drop("_failed", "_streak")


def repaired(answers: DataFrame, valid: Column, by: str = "posting_id", most_repairs: int = 2) -> DataFrame:
    """One row per call: the first valid answer within the repairs allowed, how many it took, and the outcome.

    ``answers``: ``by``, attempt (from 0), answer.
    """
    tried = answers.filter(F.col("attempt") <= most_repairs).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    rows = tried.groupBy(by).agg(F.min(F.when(F.col("_valid"), F.col("attempt"))).alias("attempt"), F.max("attempt").alias("_last"), F.min_by("answer", F.when(F.col("_valid"), F.col("attempt"))).alias("answer"))
    good = F.col("attempt").isNotNull()
    return rows.select(by, F.when(good, F.col("answer")).alias("answer"), F.coalesce("attempt", "_last").alias("repairs"), F.when(good, "ok").otherwise("enforcement_failed").alias("outcome"))


def fires(moments: DataFrame, every_minutes: int, grace_s: int, at: str = "at", by: str = "job") -> DataFrame:
    """Runs of a scheduler that was asleep at times: one row per waking with the fires due since the one before.

    ``moments``: ``by``, at (when the scheduler woke).  Fires that have piled up are
    one run, and none where the latest of them is older than the grace.
    """
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at))
    slot = lambda t: F.floor(F.unix_seconds(t) / F.lit(60 * every_minutes))
    rows = moments.withColumn("_due", slot(F.col(at)) - slot(before)).filter("_due > 0")
    late = F.unix_seconds(F.col(at)) - slot(F.col(at)) * 60 * every_minutes
    return rows.select(by, at, F.col("_due").alias("coalesced"), (late <= grace_s).alias("runs"))
