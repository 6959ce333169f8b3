"""Ingest: classify what was fetched, upsert, close what is gone, collapse duplicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import bounded_description, content_hash, lookup, title_key
from millrace.operators.screen import SUPERSEDED
from millrace.settings import DEFAULT, FIDELITY, SEEN_STATUSES, Settings
from millrace.sources.keyed import KeyedTable
from millrace.sources.lease import Lease

KEY = ("source_id", "external_id")

#: Columns that a fetch overwrites; id and first_seen_at stay.
UPDATED = (
    "company_id", "title", "department", "location_raw", "location_city", "location_country",
    "is_remote", "employment_type", "seniority_guess", "url", "description_html",
    "description_text", "content_hash", "posted_at", "last_seen_at", "closed_at", "missed_runs",
    "raw",
)


def first_of_each(fetched: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row for each key: the first one fetched."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(ordinal))
    return fetched.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def posting_id(source_id: Column, external_id: Column) -> Column:
    """A deterministic id in the form of a ULID, so that reruns and retries agree."""
    digest = F.upper(F.left(F.sha2(F.concat_ws("|", source_id.cast("string"), external_id), 256), F.lit(26)))
    return F.concat(F.translate(F.left(digest, F.lit(1)), "89ABCDEF", "01234567"), F.substring(digest, 2, 25))


def change_of(stored_id: Column, stored_hash: Column, fetched_hash: Column, stored_company: Column, company: Column) -> Column:
    moved = (stored_hash != fetched_hash) | (company.isNotNull() & (stored_company != company))
    return F.when(stored_id.isNull(), F.lit("new")).when(moved, F.lit("updated")).otherwise(F.lit("unchanged"))


def classified(fetched: DataFrame, stored: DataFrame, settings: Settings = DEFAULT, overrides: DataFrame | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Fetched rows with bounded text, hash, company, stored id and ``change``.

    ``overrides``: source_id, external_id, company_id for leads that belong to
    another company than their source.  ``hashed``: the hash that the stored rows have.
    The stored side is pruned to four columns.
    """
    text, cut = bounded_description(F.col("description_text"), settings.max_description_chars)
    rows = first_of_each(fetched).withColumn("original_chars", F.length("description_text")).withColumn("truncated", cut).withColumn("description_text", text)
    rows = rows.withColumn("content_hash", hashed(F.col("description_text")))
    if overrides is not None:
        named = overrides.select(*KEY, F.col("company_id").alias("o_company"))
        rows = rows.join(named, list(KEY), "left").withColumn("company_id", F.coalesce("o_company", "company_id")).drop("o_company")
    old = stored.select(*KEY, F.col("id").alias("stored_id"), F.col("content_hash").alias("stored_hash"), F.col("company_id").alias("stored_company"))
    joined = rows.join(old, list(KEY), "left")
    return joined.withColumn("change", change_of(F.col("stored_id"), F.col("stored_hash"), F.col("content_hash"), F.col("stored_company"), F.col("company_id"))).withColumn("id", F.coalesce("stored_id", posting_id(F.col("source_id"), F.col("external_id"))))


def change_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("change").agg(F.count("*").alias("n"))


def raw_with_flags(raw: Column, extra: Column | None, truncated: Column, original_chars: Column) -> Column:
    """The raw map with what the ingest adds; later keys win."""
    maps = [F.coalesce(raw, F.create_map().cast("map<string,string>"))]
    if extra is not None:
        maps.append(F.coalesce(extra, F.create_map().cast("map<string,string>")))
    flags = F.create_map(F.lit("description_truncated"), F.lit("true"), F.lit("description_original_chars"), original_chars.cast("string"))
    maps.append(F.when(truncated, flags).otherwise(F.create_map().cast("map<string,string>")))
    return F.map_from_entries(F.aggregate(F.array(*(F.map_entries(m) for m in maps)), F.array().cast("array<struct<key:string,value:string>>"), lambda acc, entries: F.concat(F.filter(acc, lambda old: ~F.exists(entries, lambda new: new["key"] == old["key"])), entries)))


def upserted(stored: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """The table after a fetch: one full outer join, no row-level writes needed.

    Unchanged rows are touched, updated ones overwritten, new ones inserted; rows
    that weren't fetched stay as they are.
    """
    fetched = plan.select(*[F.col(c).alias(f"p_{c}") for c in ("id", *KEY, "change", *(c for c in UPDATED if c in plan.columns))])
    joined = stored.join(fetched, (stored["source_id"] == fetched["p_source_id"]) & (stored["external_id"] == fetched["p_external_id"]), "full_outer")
    seen, written = F.col("p_id").isNotNull(), F.col("p_change").isin("new", "updated")
    fixed = {"last_seen_at": now, "missed_runs": F.lit(0), "closed_at": F.lit(None).cast("timestamp")}
    out = []
    for c in stored.columns:
        old = stored[c]
        if c in fixed:
            value = F.when(seen, fixed[c].cast(stored.schema[c].dataType)).otherwise(old)
        elif c in ("id", *KEY):
            value = F.coalesce(old, F.col(f"p_{c}"))
        elif c == "first_seen_at":
            value = F.coalesce(old, now)
        elif c == "filtered_out":
            value = F.coalesce(old, F.lit(False))
        elif c in UPDATED and f"p_{c}" in fetched.columns:
            value = F.when(written, F.col(f"p_{c}")).otherwise(old)
        else:
            value = old
        out.append(value.alias(c))
    return joined.select(*out)


#: How the versions of a stored posting merge in a keyed table.
MERGE_RULES = {"id": "first", "first_seen_at": "first"} | {c: "written" for c in UPDATED if c not in ("last_seen_at", "closed_at", "missed_runs")}


def persisted(table: KeyedTable, fetched: DataFrame, now: Column, settings: Settings = DEFAULT, overrides: DataFrame | None = None, stream: str | None = None, batch: int | None = None, lease: Lease | None = None) -> DataFrame:
    """Stores what was fetched, as deltas of the buckets it falls into; the number of rows by change.

    Only those buckets are read for the comparison.  Unchanged rows are sightings: they
    move when a posting was last seen, reopen it, and leave the rest as it is.
    """
    plan = classified(fetched, table.read_for(fetched), settings, overrides)
    version = plan.withColumns({"first_seen_at": now, "last_seen_at": now, "missed_runs": F.lit(0), "closed_at": F.lit(None).cast("timestamp")})
    counts = change_counts(plan)
    table.upsert(version, F.col("change") != "unchanged", stream, batch, lease=lease)
    return counts


def advances(status: Column) -> Column:
    """Whether a source's run counts towards closing what it didn't show."""
    return status.isin(*SEEN_STATUSES)


def missed(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """Open postings that the latest run of their source didn't see.

    ``runs``: source_id, status, seen_at; failed runs freeze their source.
    """
    live = runs.filter(advances(F.col("status"))).select(F.col("source_id").alias("r_source"), "seen_at")
    return postings.filter(F.col("closed_at").isNull()).join(live, postings["source_id"] == live["r_source"]).filter(F.col("last_seen_at") < F.col("seen_at")).drop("r_source")


def close_delta(unseen: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """id, missed_runs, closed_at after the run; null closed_at: only the counter moved."""
    count = F.col("missed_runs") + 1
    return unseen.select("id", count.alias("missed_runs"), F.when(count >= settings.close_after, F.col("seen_at")).alias("closed_at"))


def apply_close(postings: DataFrame, delta: DataFrame) -> DataFrame:
    new = delta.select(F.col("id").alias("d_id"), F.col("missed_runs").alias("d_missed"), F.col("closed_at").alias("d_closed"))
    joined = postings.join(new, postings["id"] == new["d_id"], "left")
    return joined.withColumn("missed_runs", F.coalesce("d_missed", "missed_runs")).withColumn("closed_at", F.coalesce("d_closed", "closed_at")).drop("d_id", "d_missed", "d_closed")


def fidelity(adapter: Column) -> Column:
    return F.coalesce(lookup(adapter, FIDELITY), F.lit(0))


def collapse_candidates(postings: DataFrame, sources: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Open postings with their adapter; of touched companies only, where given.

    A group lies within one company, so untouched companies can't change.
    """
    adapters = sources.select(F.col("id").alias("s_id"), "adapter")
    rows = postings.filter(F.col("closed_at").isNull())
    if touched is not None:
        rows = rows.join(touched.select("company_id").distinct(), "company_id", "left_semi")
    rows = rows.join(adapters, rows["source_id"] == adapters["s_id"])
    return rows.select("id", "company_id", "title", "location_city", "adapter", "source_id", "content_hash", "first_seen_at", "filtered_out", "filter_reason")


#: What postings of one role have in common; a missing city is a value like any other.
ROLE = ("company_id", "title_key", "location_city")


def _same_role(rows: DataFrame, other: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (rows[name].eqNullSafe(other[f"g_{name}"]) for name in ROLE))


def by_role(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("title_key", title_key(F.col("title")))


def winners(rows: DataFrame) -> DataFrame:
    """The role's columns and ``w``: the most trusted, then oldest, then smallest id of each role.

    An aggregate, so a role with very many postings is combined where they are.
    """
    order = F.struct((-fidelity(F.col("adapter"))).alias("trust"), "first_seen_at", "id")
    return rows.groupBy(*ROLE).agg(F.min_by(F.struct("id", "source_id", "content_hash"), order).alias("w"))


def _planned(rows: DataFrame, best: DataFrame) -> DataFrame:
    named = best.select(*(F.col(name).alias(f"g_{name}") for name in ROLE), "w")
    rows = rows.join(named, _same_role(rows, named))
    loses = (F.col("id") != F.col("w.id")) & ((F.col("source_id") != F.col("w.source_id")) | (F.col("content_hash") == F.col("w.content_hash")))
    was = F.col("filtered_out") & F.startswith(F.coalesce("filter_reason", F.lit("")), F.lit(SUPERSEDED))
    known = F.col("filtered_out") & F.col("filter_reason").eqNullSafe(F.concat(F.lit(SUPERSEDED), F.col("w.id").cast("string")))
    action = F.when(loses & ~known, F.lit("supersede")).when(~loses & was, F.lit("restore"))
    return rows.withColumn("action", action).filter("action is not null").select("id", F.when(F.col("action") == "supersede", F.col("w.id")).alias("winner_id"), "action")


def collapse_plan(candidates: DataFrame) -> DataFrame:
    """Rows whose flags a collapse changes: id, winner_id, action.

    Within one role the winner stays.  Others are superseded if they come from another
    source or have the same text; rows that no longer lose are restored.
    """
    rows = by_role(candidates)
    return _planned(rows, winners(rows))


def winners_table(spark: SparkSession, path: str, candidates: DataFrame, buckets: int = 64) -> KeyedTable:
    """A new table of the winners of all roles."""
    best = winners(by_role(candidates))
    table = KeyedTable.create(spark, path, best.schema, ROLE, buckets=buckets)
    table.upsert(best)
    return table


def collapse_changed(table: KeyedTable, candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """The plan for the roles that ``changed`` postings are or were of; winners of those roles alone are computed anew.

    ``changed``: company_id, title, location_city, with the old values of a posting that moved
    as a row of its own.  Roles without a posting keep no winner.
    """
    touched = by_role(changed).select(*(F.col(name).alias(f"g_{name}") for name in ROLE)).distinct()
    rows = by_role(candidates)
    own = rows.join(touched, _same_role(rows, touched), "left_semi")
    best = winners(own)
    plain = touched.select(*(F.col(f"g_{name}").alias(name) for name in ROLE))
    renamed = best.select(*(F.col(name).alias(f"g_{name}") for name in ROLE))
    gone = plain.join(renamed, _same_role(plain, renamed), "left_anti").withColumn("w", F.lit(None).cast(best.schema["w"].dataType))
    table.upsert(best.unionByName(gone))
    return _planned(own, best)


def collapse_delta(plan: DataFrame) -> DataFrame:
    """id, filtered_out, filter_reason, as ``screen.apply_delta`` takes them."""
    out = F.col("action") == "supersede"
    return plan.select("id", out.alias("filtered_out"), F.when(out, F.concat(F.lit(SUPERSEDED), F.col("winner_id").cast("string"))).alias("filter_reason"))


def due_sources(sources: DataFrame, companies: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Enabled sources of tracked companies whose poll interval has passed."""
    tracked = companies.filter((F.col("status") == "tracking") & F.col("deleted_at").isNull()).select(F.col("id").alias("c_id"))
    rows = sources.filter("enabled").join(tracked, sources["company_id"] == tracked["c_id"]).drop("c_id")
    if force:
        return rows
    next_run = F.col("last_run_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("poll_interval_minutes"))
    return rows.filter(F.col("last_run_at").isNull() | (next_run <= now))


def source_health(sources: DataFrame, outcomes: DataFrame, disable_at: int = 5) -> DataFrame:
    """Sources after a run: failures reset, freeze or count, and disable in the end.

    ``outcomes``: source_id, status, error, run_at.
    """
    new = outcomes.select(F.col("source_id").alias("o_id"), F.col("status").alias("o_status"), F.col("error").alias("o_error"), F.col("run_at").alias("o_at"))
    rows = sources.join(new, sources["id"] == new["o_id"], "left")
    ran = F.col("o_id").isNotNull()
    good = F.col("o_status").isin(*SEEN_STATUSES)
    fault = ran & ~F.col("o_status").isin("ok", "empty", "rate_limited", "circuit_open", "disabled")
    failures = F.when(good, F.lit(0)).when(fault, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    return (
        rows.withColumn("consecutive_failures", failures)
        .withColumn("enabled", F.when(fault & (F.col("consecutive_failures") >= disable_at), F.lit(False)).otherwise(F.col("enabled")))
        .withColumn("last_status", F.coalesce("o_status", "last_status"))
        .withColumn("last_error", F.when(good, F.lit(None).cast("string")).otherwise(F.coalesce("o_error", "last_error")))
        .withColumn("last_run_at", F.coalesce("o_at", "last_run_at"))
        .drop("o_id", "o_status", "o_error", "o_at")
    )


def status_of_error(code: Column) -> Column:
    """The run status that a downloader's error code means."""
    cases = {"http": "http_error", "schema": "schema_error", "timeout": "timeout", "rate": "rate_limited", "circuit": "circuit_open", "robots": "robots_denied", "policy": "denied_by_policy"}
    out = F.when(code.isNull(), F.lit("ok"))
    for start, status in cases.items():
        out = out.when(F.startswith(code, F.lit(start)), F.lit(status))
    return out.otherwise(F.lit("error"))


def stranded_runs(runs: DataFrame, now: Column, older_than_s: int) -> DataFrame:
    """Runs with those failed that have been running for too long."""
    late = (F.col("status") == "running") & (F.col("started_at") <= now - F.make_dt_interval(secs=F.lit(older_than_s)))
    return runs.withColumn("finished_at", F.when(late, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(late, F.lit("failed")).otherwise(F.col("status")))
