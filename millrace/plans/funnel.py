"""Application funnel analytics over an append-only event log.

``applications``: id, posting_id, variant_id, company_id, status, submitted_at,
source_channel; ``events``: id, application_id, status, occurred_at.  ``as_of`` is
always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scores import status_rank, terminal, wilson
from millrace.plans.quantiles import exact_quantile


def folded_status(events: DataFrame) -> DataFrame:
    """application_id, status: the latest terminal event, else the furthest one.

    The fold is associative and commutative, so order and batches don't matter.
    """
    latest = F.struct("occurred_at", "id")
    last = F.max_by("status", F.when(terminal(F.col("status")), latest))
    far = F.max_by("status", F.struct(status_rank(F.col("status")).alias("r"), "occurred_at", "id"))
    ended = F.count_if(terminal(F.col("status"))) > 0
    return events.groupBy("application_id").agg(F.when(ended, last).otherwise(far).alias("status"))


def with_status(applications: DataFrame, events: DataFrame) -> DataFrame:
    """Applications with the status of their events, "submitted" without any."""
    folded = folded_status(events).select(F.col("application_id").alias("id"), F.col("status").alias("_s"))
    return applications.drop("status").join(folded, "id", "left").withColumn("status", F.coalesce("_s", F.lit("submitted"))).drop("_s")


def last_events(events: DataFrame) -> DataFrame:
    return events.groupBy("application_id").agg(F.max("occurred_at").alias("last_event_at"), F.count("*").alias("n_events"))


def funnel(applications: DataFrame, companies: DataFrame) -> DataFrame:
    """Current stages by variant, tier and week."""
    s = F.col("status")
    rows = applications.join(companies.select(F.col("id").alias("company_id"), "tier"), "company_id")
    return rows.groupBy("variant_id", "tier", F.date_trunc("week", "submitted_at").alias("week")).agg(
        F.count("*").alias("submitted"),
        F.count_if(~s.isin("submitted", "withdrawn")).alias("responded"),
        F.count_if(s == "withdrawn").alias("withdrawn"),
        F.count_if(s.isin("screening", "interview", "offer")).alias("advanced"),
        F.count_if(s == "interview").alias("interviewed"),
        F.count_if(s == "offer").alias("offers"),
    )


def ever_reached(applications: DataFrame, events: DataFrame, companies: DataFrame) -> DataFrame:
    """How many ever got to a stage, by variant and tier; withdrawn ones left out."""
    best = events.groupBy("application_id").agg(F.max(status_rank(F.col("status"))).alias("r"))
    rows = applications.filter("status <> 'withdrawn'").join(companies.select(F.col("id").alias("company_id"), "tier"), "company_id")
    rows = rows.join(best, rows["id"] == best["application_id"], "left")
    stages = {"ever_acknowledged": 1, "ever_screened": 2, "ever_interviewed": 3, "ever_offered": 4}
    return rows.groupBy("variant_id", "tier").agg(F.count("*").alias("submitted"), *(F.count_if(F.col("r") >= k).alias(name) for name, k in stages.items()))


def first_response(applications: DataFrame, events: DataFrame, companies: DataFrame) -> DataFrame:
    """Median days to the first event besides submission, by tier."""
    first = events.filter("status <> 'submitted'").groupBy("application_id").agg(F.min("occurred_at").alias("at"))
    rows = applications.join(companies.select(F.col("id").alias("company_id"), "tier"), "company_id").join(first, F.col("id") == F.col("application_id"))
    micros = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("submitted_at").cast("timestamp"))
    return exact_quantile(rows, ["tier"], micros).select("tier", (F.col("quantile") / 86_400_000_000.0).alias("median_days"), "n")


def ghosted(applications: DataFrame, events: DataFrame, as_of: Column, after_days: int = 30) -> DataFrame:
    """Applications without an answer for longer than ``after_days``."""
    last = last_events(events)
    rows = applications.filter(F.col("status").isin("submitted", "acknowledged")).join(last, F.col("id") == F.col("application_id"), "left")
    at = F.coalesce("last_event_at", "submitted_at")
    return rows.filter(at < as_of - F.make_dt_interval(F.lit(after_days))).select("id", "posting_id", "submitted_at", at.alias("last_event_at"))


#: Quiet days after which a status calls for a follow-up.
QUIET_DAYS = {"screening": 7, "interview": 7, "acknowledged": 10, "submitted": 14}


def follow_ups(applications: DataFrame, events: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Live applications that were quiet for longer than their status warrants, with the reason."""
    rows = applications.filter(F.col("status").isin(*QUIET_DAYS)).join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "tier"), "company_id")
    rows = rows.join(last_events(events), F.col("id") == F.col("application_id"), "left")
    at = F.coalesce("last_event_at", "submitted_at")
    s = F.col("status")
    limit = F.when(s.isin("screening", "interview"), 7).when(s == "acknowledged", 10).otherwise(14)
    reason = F.when((s == "submitted") & (F.col("source_channel") == "referral"), "ping_referrer").when(s == "submitted", "no_ack").when(s == "acknowledged", "no_progress").otherwise("awaiting_next_step")
    quiet = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))) / 86_400).cast("int")
    due = at < as_of - F.make_dt_interval(limit)
    return rows.filter(due).select(F.col("id").alias("application_id"), "company_name", "tier", "status", "source_channel", "submitted_at", "last_event_at", quiet.alias("quiet_days"), reason.alias("reason"))


def todays_follow_ups(due: DataFrame, most: int = 3) -> DataFrame:
    """The few to act on: by tier, then the longest quiet."""
    rank = F.when(F.col("tier") == "dream", 0).when(F.col("tier") == "strong", 1).otherwise(2)
    return due.orderBy(rank, F.desc("quiet_days"), "application_id").limit(most)


def response_rates(funnel_rows: DataFrame, *by: str) -> DataFrame:
    """Responses with the bounds of their rate, by the given columns."""
    sums = funnel_rows.groupBy(*by).agg(F.sum("responded").alias("responded"), F.sum("submitted").alias("submitted"))
    low, high = wilson(F.col("responded").cast("double"), F.col("submitted").cast("double"))
    return sums.withColumn("low", low).withColumn("high", high)


def mail_review_queue(mails: DataFrame, events: DataFrame) -> DataFrame:
    """Classified mail that nobody acted on: no event, and unlinked or too uncertain."""
    kept = mails.filter(F.col("processed_at").isNotNull() & F.col("classified_as").isNotNull() & ~F.col("classified_as").isin("job_alert", "unrelated"))
    unused = kept.join(events.select(F.col("email_message_id").alias("id")), "id", "left_anti")
    sure = F.when(F.col("classified_as").isin("rejection", "offer"), 0.90).otherwise(0.80)
    return unused.filter(F.col("application_id").isNull() | (F.col("confidence") < sure))
