"""Operational reports: runs, sources, claims, costs, integrity."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import lookup
from millrace.settings import COMPLETED_STATUSES, SEEN_STATUSES

#: What one source's run leaves behind.
SOURCE_RESULT = "struct<source_id:bigint,describe:string,status:string,fetched:bigint,new:bigint,updated:bigint,unchanged:bigint,skipped:map<string,bigint>,requests:bigint,retries:bigint,rate_limit_wait_ms:bigint,duration_ms:bigint,error:string,error_code:string>"


# -- one run


def folded_results(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Run statistics of per-source results, in one row (or one for each ``by``)."""
    s = F.col("status")
    sums = ("fetched", "new", "updated", "unchanged", "requests", "retries", "rate_limit_wait_ms")
    return results.groupBy(*by).agg(
        F.count("*").alias("sources_total"),
        F.count_if(s == "ok").alias("sources_ok"),
        F.count_if(s == "empty").alias("sources_empty"),
        F.count_if(~s.isin(*COMPLETED_STATUSES)).alias("sources_failed"),
        F.count_if(s == "disabled").alias("sources_disabled"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums if c in results.columns),
    )


def skipped_by_reason(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the skipped maps by reason."""
    rows = results.select(*by, F.explode("skipped").alias("reason", "n"))
    return rows.groupBy(*by, "reason").agg(F.sum("n").alias("n"))


def run_status(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """"completed" if every source ended well, no sources included."""
    good = F.coalesce(F.every(F.col("status").isin(*COMPLETED_STATUSES)), F.lit(True))
    return results.groupBy(*by).agg(F.when(good, F.lit("completed")).otherwise(F.lit("completed_with_errors")).alias("status"))


def failure_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Headline of the failures by status; no row without failures."""
    counts = results.filter(~F.col("status").isin(*COMPLETED_STATUSES)).groupBy(*by, "status").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("status", "n")))
    text = F.concat(F.sum("n").cast("string"), F.lit(" source(s) failed: "), F.array_join(F.transform(parts, lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["status"])), ", "))
    out = counts.groupBy(*by).agg(text.alias("summary"))
    return out.filter("summary is not null")


def results_payload(results: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per-source results of each run as an array ordered by source.

    One run has at most one entry for each registered source, hundreds of them; for
    anything that isn't so bounded keep the rows and use ``folded_results``.
    """
    fields = [c for c in results.columns if c not in by]
    entry = F.struct("source_id", F.struct(*fields).alias("r"))
    return results.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias("source_results"))


def run_log_row(stats: DataFrame, run_id: str, started_at: Column, finished_at: Column, run_type: str = "discovery") -> DataFrame:
    return stats.select(F.lit(run_id).alias("id"), F.lit(run_type).alias("run_type"), started_at.alias("started_at"), finished_at.alias("finished_at"), F.to_json(F.struct(*stats.columns)).alias("stats"))


# -- many runs


def exploded_runs(runs: DataFrame, column: str = "source_results") -> DataFrame:
    """One row per run and source; ``column`` is JSON text or an array of structs."""
    array = F.col(column) if dict(runs.dtypes)[column].startswith("array") else F.from_json(column, f"array<{SOURCE_RESULT}>")
    rest = [c for c in runs.columns if c != column]
    return runs.select(*[F.col(c).alias(f"run_{c}") for c in rest], F.explode(array).alias("r")).select(*[f"run_{c}" for c in rest], "r.*")


def recent(runs: DataFrame, as_of: Column, days: int, run_type: str = "discovery") -> DataFrame:
    return runs.filter((F.col("run_type") == run_type) & (F.col("started_at") > as_of - F.make_dt_interval(F.lit(days))))


def failure_trend(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rows = exploded_runs(recent(runs, as_of, days)).filter(~F.col("status").isin(*SEEN_STATUSES))
    return rows.groupBy("describe", "status").agg(F.count("*").alias("occurrences"))


def always_empty(runs: DataFrame, as_of: Column, days: int = 7, least: int = 7) -> DataFrame:
    rows = exploded_runs(recent(runs, as_of, days)).filter("status = 'empty'")
    return rows.groupBy("source_id").agg(F.count("*").alias("empty_runs")).filter(F.col("empty_runs") >= least)


def latest_failures(runs: DataFrame, run_type: str = "discovery") -> DataFrame:
    latest = runs.filter(F.col("run_type") == run_type).orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    return exploded_runs(latest).filter(~F.col("status").isin(*SEEN_STATUSES)).select("describe", "status", "error_code", "error", "fetched", "new", "duration_ms", "retries")


def result_of(runs: DataFrame, source_id: int) -> DataFrame:
    """The first result of one source in each run."""
    found = F.try_element_at(F.filter(F.from_json("source_results", f"array<{SOURCE_RESULT}>"), lambda r: r["source_id"] == source_id), F.lit(1))
    return runs.select("id", found.alias("result"))


def duration_trend(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    seconds = F.unix_seconds("finished_at") - F.unix_seconds("started_at")
    return recent(runs, as_of, days).select(F.to_date("started_at").alias("day"), seconds.alias("seconds"), "status", F.json_array_length("source_results").alias("sources_attempted"))


def latest_run_per_day(runs: DataFrame) -> DataFrame:
    """day, run_type, runs, last_status, last_run."""
    last = F.max_by(F.struct("status", "id"), F.struct("started_at", "id"))
    return runs.groupBy(F.to_date("started_at").alias("day"), "run_type").agg(F.count("*").alias("runs"), last.alias("l")).select("day", "run_type", "runs", F.col("l.status").alias("last_status"), F.col("l.id").alias("last_run"))


def newest_runs(runs: DataFrame, most: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(most)


def _stat(name: str, kind: str) -> Column:
    return F.get_json_object("stats", f"$.{name}").try_cast(kind)


def daily_model_totals(runs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    rows = runs.filter(F.col("started_at") > as_of - F.make_dt_interval(F.lit(days)))
    counts = {"calls": "llm_calls", "repairs": "repair_retries", "cache_hits": "cache_hits", "extracted": "extracted", "generated": "generated"}
    return rows.groupBy(F.to_date("started_at").alias("day")).agg(F.sum(_stat("llm_cost_inr", "decimal(18,2)")).alias("inr"), *(F.sum(_stat(key, "bigint")).alias(name) for name, key in counts.items()))


def cost_per_posting(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    cost, extracted = _stat("llm_cost_inr", "decimal(18,2)"), _stat("extracted", "bigint")
    return recent(runs, as_of, days).select(F.to_date("started_at").alias("day"), F.round(cost, 2).alias("cost_inr"), extracted.alias("extracted"), F.round(F.try_divide(cost, extracted), 3).alias("inr_per_posting"))


def cache_hits(runs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    hits, extracted = _stat("extract_cache_hits", "bigint"), _stat("extracted", "bigint")
    return recent(runs, as_of, days).select(F.to_date("started_at").alias("day"), extracted.alias("extracted"), hits.alias("cache_hits"), F.round(F.try_divide(hits * F.lit(100.0), extracted), 1).alias("hit_pct"))


def running_cost(calls: DataFrame, budget: float, by: str = "run_id", order: str = "call_id") -> DataFrame:
    """Calls with what was spent until then, and whether the budget still stood before each.

    ``calls``: the run, the call's order and cost_inr, rounded for each call.
    """
    until = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum("cost_inr").over(until)
    return calls.withColumn("spent_inr", spent).withColumn("open", F.col("spent_inr") - F.col("cost_inr") >= F.lit(budget).cast("decimal(18,2)"))


def extraction_estimate(postings: DataFrame, max_tokens: int, column: str = "description_text") -> DataFrame:
    """postings and input tokens, four characters each, bounded per posting."""
    tokens = F.least(F.lit(max_tokens), F.floor(F.length(F.coalesce(column, F.lit(""))) / 4))
    return postings.agg(F.count("*").alias("postings"), F.coalesce(F.sum(tokens), F.lit(0)).alias("input_tokens"))


# -- sources and postings


def sources_needing_attention(sources: DataFrame, companies: DataFrame, good: tuple[str, ...] = SEEN_STATUSES) -> DataFrame:
    """Failing, disabled or badly ended sources; one that never ran isn't one of them."""
    rows = sources.join(companies.select(F.col("id").alias("company_id"), "slug"), "company_id")
    bad = F.coalesce(~F.col("last_status").isin(*good), F.lit(False))
    return rows.filter((F.col("consecutive_failures") > 0) | ~F.col("enabled") | bad)


def filtered_sources(sources: DataFrame, company_id=None, adapter=None, last_status=None, failing=False, enabled=None) -> DataFrame:
    tests = [F.col(c) == v for c, v in (("company_id", company_id), ("adapter", adapter), ("last_status", last_status), ("enabled", enabled)) if v is not None]
    if failing:
        tests.append(F.col("consecutive_failures") > 0)
    return reduce(DataFrame.filter, tests, sources)


def open_counts(postings: DataFrame) -> DataFrame:
    """Open, visible postings by source."""
    return postings.filter(F.col("closed_at").isNull() & ~F.col("filtered_out")).groupBy("source_id").agg(F.count("*").alias("open"))


def source_list(sources: DataFrame, companies: DataFrame, postings: DataFrame) -> DataFrame:
    """Sources with their owner and number of open postings."""
    rows = sources.join(companies.select(F.col("id").alias("company_id"), "slug"), "company_id", "left")
    counts = open_counts(postings).withColumnRenamed("source_id", "id")
    return rows.join(counts, "id", "left").withColumn("open", F.coalesce("open", F.lit(0)))


def companies_by_source(companies: DataFrame, sources: DataFrame) -> DataFrame:
    """Companies with their sources, those without one first."""
    side = sources.select(F.col("company_id").alias("id"), "adapter", "enabled")
    return companies.join(side, "id", "left").orderBy(F.col("adapter").isNull().desc(), "slug")


def listed_companies(companies: DataFrame, status: str | None = None, tier: str | None = None, deleted: bool = False) -> DataFrame:
    rows = companies if deleted else companies.filter("deleted_at is null")
    for name, value in (("status", status), ("tier", tier)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy("name")


def company_of(companies: DataFrame, reference: str) -> DataFrame:
    """By id if the reference is a number, else by slug."""
    return companies.filter(F.col("id") == int(reference)) if reference.isdigit() else companies.filter(F.col("slug") == reference)


def posting_counts(postings: DataFrame) -> DataFrame:
    """visible, closed, filtered, total."""
    out, shut = F.col("filtered_out"), F.col("closed_at").isNotNull()
    return postings.agg(F.count_if(~shut & ~out).alias("visible"), F.count_if(shut).alias("closed"), F.count_if(out).alias("filtered"), F.count("*").alias("total"))


def duplicate_identities(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source_id", "external_id").agg(F.count("*").alias("n")).filter("n > 1")


def superseded_pairs(postings: DataFrame) -> DataFrame:
    """same_text, same_source, n over superseded postings and their winners."""
    losers = postings.filter(F.startswith("filter_reason", F.lit("superseded_by:"))).select(F.expr("substring(filter_reason, 15)").alias("winner"), F.col("content_hash").alias("lh"), F.col("source_id").alias("ls"))
    winners = postings.select(F.col("id").cast("string").alias("winner"), F.col("content_hash").alias("wh"), F.col("source_id").alias("ws"))
    joined = losers.join(winners, "winner")
    return joined.groupBy((F.col("lh") == F.col("wh")).alias("same_text"), (F.col("ls") == F.col("ws")).alias("same_source")).agg(F.count("*").alias("n"))


def missed_runs(postings: DataFrame) -> DataFrame:
    shut = F.col("closed_at").isNotNull()
    return postings.groupBy("missed_runs").agg(F.count_if(~shut).alias("still_open"), F.count_if(shut).alias("closed"))


def alert_sources(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """Open leads and companies of each mail source."""
    rows = sources.filter("adapter = 'mail_alert'").join(postings.select(F.col("source_id").alias("id"), F.col("company_id").alias("p_company"), "closed_at"), "id", "left")
    return rows.groupBy("id", "last_status", "consecutive_failures").agg(F.count_if(F.col("p_company").isNotNull() & F.col("closed_at").isNull()).alias("open_leads"), F.countDistinct("p_company").alias("across_companies"))


def unmatched_leads(postings: DataFrame, companies: DataFrame) -> DataFrame:
    own = companies.filter("slug = 'unmatched'").select(F.col("id").alias("company_id"), "slug")
    return postings.join(own, "company_id").groupBy("slug").agg(F.count("*").alias("n"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def counts_in_one_row(tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = table_counts(tables)
    return rows.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("table_name") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Number of rows whose parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count("*").alias("orphans"))


# -- registry


def canonical_config(config: Column) -> Column:
    """JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))


# Keys that say which board a source is, in order.
IDENTITY_KEYS = ("board_token", "site", "board_name", "company_id", "account", "company", "host", "tenant", "label")


def config_identity(config: Column) -> Column:
    return F.coalesce(*(F.when(F.try_element_at(config, F.lit(k)) != "", F.concat(F.lit(f"{k}="), F.try_element_at(config, F.lit(k)))) for k in IDENTITY_KEYS))


def redacted(config: Column, secret: str = "(?i)token|secret|password|key") -> Column:
    return F.transform_values(config, lambda k, v: F.when(k.rlike(secret) & ~k.isin(*IDENTITY_KEYS), F.lit("***")).otherwise(v))


# What a company tag can be about.
TAG_AXES = ("sector", "stage", "geo", "role", "origin", "watch")


def clean_tags(tags: Column) -> Column:
    """Different lower-case tags, sorted; null if one isn't axis:value of a known axis."""
    lowered = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    good = F.forall(lowered, lambda t: t.rlike(f"^({'|'.join(TAG_AXES)}):.+"))
    return F.when(good, F.array_sort(F.array_distinct(lowered)))


def find_source(sources: DataFrame, company_id: int, adapter: str, config: Column) -> DataFrame:
    return sources.filter((F.col("company_id") == company_id) & (F.col("adapter") == adapter) & (canonical_config(F.col("config")) == canonical_config(config)))


def inserted_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those new rows whose keys it lacks."""
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def with_enabled(sources: DataFrame, source_id: int, enabled: bool, retired: bool = False) -> DataFrame:
    """Sources with one switched; switching on forgets its failures, retiring too."""
    own = F.col("id") == source_id
    status = "retired" if retired else "disabled"
    out = sources.withColumn("enabled", F.when(own, F.lit(enabled)).otherwise(F.col("enabled")))
    if enabled or retired:
        out = out.withColumn("consecutive_failures", F.when(own, F.lit(0)).otherwise(F.col("consecutive_failures")))
    if enabled:
        return out.withColumn("last_error", F.when(own, F.lit(None).cast("string")).otherwise(F.col("last_error")))
    return out.withColumn("last_status", F.when(own, F.lit(status)).otherwise(F.col("last_status")))


def with_company_status(companies: DataFrame, company_id: int, status: str) -> DataFrame:
    return companies.withColumn("status", F.when(F.col("id") == company_id, F.lit(status)).otherwise(F.col("status")))


def without_source(sources: DataFrame, postings: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources and postings without one source, and how many postings that takes."""
    gone = postings.filter(F.col("source_id") == source_id).agg(F.count("*").alias("postings_deleted"))
    return sources.filter(F.col("id") != source_id), postings.filter(F.col("source_id") != source_id), gone


# -- claims


def claims_due(claims: DataFrame, as_of: Column, expiring_days: int = 30, stale_days: int = 180) -> DataFrame:
    soon = F.col("expires_at") < as_of + F.make_dt_interval(F.lit(expiring_days))
    old = F.col("verified_at") < as_of - F.make_dt_interval(F.lit(stale_days))
    rows = claims.filter(F.col("deleted_at").isNull() & (F.coalesce(soon, F.lit(False)) | F.coalesce(old, F.lit(False))))
    return rows.withColumn("expired", F.col("expires_at") < as_of).withColumn("expiring", soon).orderBy(F.asc_nulls_last("expires_at"), "verified_at")


def claims_of_artifact(usage: DataFrame, claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Claims behind each artifact, and whether they were stale when it was made."""
    c = claims.select(F.col("id").alias("claim_id"), "key", "expires_at")
    a = artifacts.select(F.col("id").alias("artifact_id"), "kind", "generated_at")
    stale = F.col("expires_at").isNotNull() & (F.col("expires_at") < F.col("generated_at"))
    return usage.join(c, "claim_id").join(a, "artifact_id").withColumn("was_stale", stale)


def artifact_links(applications: DataFrame) -> DataFrame:
    """(application_id, artifact_id): two columns exploded, so joins on them stay equi joins."""
    pairs = applications.select(F.col("id").alias("application_id"), F.explode(F.array_distinct(F.array("resume_artifact_id", "cover_letter_artifact_id"))).alias("artifact_id"))
    return pairs.filter("artifact_id is not null")


def claims_of_application(applications: DataFrame, usage: DataFrame, claims: DataFrame, artifacts: DataFrame, as_of: Column) -> DataFrame:
    rows = claims_of_artifact(usage, claims, artifacts).join(artifact_links(applications), "artifact_id")
    return rows.withColumn("expired_now", F.col("expires_at").isNotNull() & (F.col("expires_at") < as_of))


def claim_uses(usage: DataFrame, artifacts: DataFrame, applications: DataFrame) -> DataFrame:
    """Every artifact that asserts a claim, with what became of it."""
    a = artifacts.select(F.col("id").alias("artifact_id"), "kind", "generated_at", "posting_id")
    links = artifact_links(applications).join(applications.select(F.col("id").alias("application_id"), F.col("status").alias("application_status")), "application_id")
    return usage.join(a, "artifact_id").join(links, "artifact_id", "left")


def invalid_artifacts(artifacts: DataFrame, by: str = "application_id") -> DataFrame:
    """Headline of the artifacts that failed validation."""
    label = F.concat(F.col("id").cast("string"), F.lit(" ("), F.col("kind"), F.lit(")"))
    return artifacts.filter(~F.col("validated")).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("offending"))


# -- versions of scores


def version_deltas(scores: DataFrame, before: str, after: str) -> DataFrame:
    """variant_id, postings, mean and deviation of the score change, large moves."""
    a = scores.filter(F.col("prompt_version") == before).select("posting_id", "variant_id", F.col("composite_score").alias("a"))
    b = scores.filter(F.col("prompt_version") == after).select("posting_id", "variant_id", F.col("composite_score").alias("b"))
    change = F.col("b") - F.col("a")
    return a.join(b, ["posting_id", "variant_id"]).groupBy("variant_id").agg(F.count("*").alias("postings"), F.avg(change).alias("mean_delta"), F.stddev(change).alias("sd_delta"), F.count_if(F.abs(change) > 10).alias("large_moves"))


def flip_rate(scores: DataFrame, before: str, after: str) -> DataFrame:
    """Share of postings for which the two versions prefer different variants."""
    best = F.min_by("variant_id", F.struct((-F.col("composite_score")).alias("s"), F.col("variant_id")))
    winners = scores.filter(F.col("prompt_version").isin(before, after)).groupBy("posting_id").agg(
        F.min_by("variant_id", F.when(F.col("prompt_version") == before, F.struct((-F.col("composite_score")).alias("s"), F.col("variant_id")))).alias("a"),
        F.min_by("variant_id", F.when(F.col("prompt_version") == after, F.struct((-F.col("composite_score")).alias("s"), F.col("variant_id")))).alias("b"),
        best.alias("_"),
    )
    both = winners.filter("a is not null and b is not null")
    return both.agg(F.try_divide(F.count_if(F.col("a") != F.col("b")), F.count("*")).alias("flip_rate"))


def reason_alias(family: Column) -> Column:
    """Chain name of a stored reason family."""
    # Families that aren't named like their predicate.
    names = {"title_keyword": "title_denylist", "company_blacklisted": "company_status", "description_too_short": "no_description", "location_excluded": "location"}
    return F.coalesce(lookup(family, names), family)
