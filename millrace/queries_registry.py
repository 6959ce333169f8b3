"""Registered queries of the registry, runs, claims, requirements, variants and evaluation, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import query, table, with_
from millrace.functions import scores, text
from millrace.operators import evaluation, ingest, matching, requirements, screen, scoring, variants
from millrace.operators.vocabulary import Skill, Vocabulary, duplicate_aliases, rebound_version, unresolved_composites
from millrace.plans import diagnostics, fetching, funnel, reports, standins
from millrace.plans.standins import run
from millrace.session import shared_folder
from millrace.settings import GATES
from millrace.sources import files, seeds, sinks

# ---------------------------------------------------------------- sources and companies

SOURCES = """
SELECT s_suppkey AS id, s_nationkey AS company_id, CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'mail_alert' END AS adapter,
  s_suppkey % 7 <> 0 AS enabled, CAST(greatest(0, s_suppkey % 6 - 3) AS INT) AS consecutive_failures,
  CASE s_suppkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'timeout' WHEN 3 THEN 'http_error' END AS last_status,
  CASE WHEN s_suppkey % 3 = 0 THEN 'refused' END AS last_error
FROM supplier
"""
OWNERS = """
SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name, CASE n_regionkey WHEN 0 THEN 'dream' WHEN 1 THEN 'strong' ELSE 'volume' END AS tier,
  CASE WHEN n_nationkey % 5 = 2 THEN 'blacklisted' ELSE 'tracking' END AS status, CASE WHEN n_nationkey % 9 = 8 THEN n_name END AS deleted_at
FROM nation
"""
_REG = dict(sources=SOURCES, owners=OWNERS)


def _sources(spark, sf_dir) -> DataFrame:
    return run(spark, sf_dir, SOURCES)


def _owners(spark, sf_dir) -> DataFrame:
    return run(spark, sf_dir, OWNERS)


@query("filtered_sources", with_(**_REG) + "SELECT id, adapter FROM sources WHERE adapter = 'lever' AND consecutive_failures > 0 AND enabled UNION ALL SELECT id, adapter FROM sources WHERE company_id = 3 AND last_status = 'ok'")
def filtered_sources(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    one = reports.filtered_sources(rows, adapter="lever", failing=True, enabled=True)
    return one.unionByName(reports.filtered_sources(rows, company_id=3, last_status="ok")).select("id", "adapter")


@query("listed_companies", with_(**_REG) + "SELECT name, 'dream' AS list FROM owners WHERE deleted_at IS NULL AND tier = 'dream' UNION ALL SELECT name, 'blacklisted' FROM owners WHERE status = 'blacklisted'")
def listed_companies(spark, sf_dir):
    rows = _owners(spark, sf_dir)
    dream = reports.listed_companies(rows, tier="dream").select("name", F.lit("dream").alias("list"))
    return dream.unionByName(reports.listed_companies(rows, status="blacklisted", deleted=True).select("name", F.lit("blacklisted").alias("list")))


@query("company_by_reference", with_(**_REG) + "SELECT id, slug FROM owners WHERE id = 7 UNION ALL SELECT id, slug FROM owners WHERE slug = 'nation_4'")
def company_by_reference(spark, sf_dir):
    rows = _owners(spark, sf_dir)
    return reports.company_of(rows, "7").unionByName(reports.company_of(rows, "nation_4")).select("id", "slug")


@query("companies_by_source", with_(**_REG) + "SELECT o.slug, adapter, enabled FROM owners o LEFT JOIN sources s ON s.company_id = o.id")
def companies_by_source(spark, sf_dir):
    return reports.companies_by_source(_owners(spark, sf_dir), _sources(spark, sf_dir)).select("slug", "adapter", "enabled")


@query("alert_sources", with_(**_REG, postings=standins.POSTINGS) + """SELECT s.id, count(p.company_id) FILTER (p.closed_at IS NULL) AS open_leads, count(DISTINCT p.company_id) AS across_companies
FROM sources s LEFT JOIN postings p ON p.source_id = s.id WHERE s.adapter = 'mail_alert' GROUP BY 1""")
def alert_sources(spark, sf_dir):
    return reports.alert_sources(_sources(spark, sf_dir), run(spark, sf_dir, standins.POSTINGS)).select("id", "open_leads", "across_companies")


@query("unmatched_leads", with_(postings=standins.POSTINGS) + "SELECT 'unmatched' AS slug, count(*) AS n FROM postings WHERE company_id = 4")
def unmatched_leads(spark, sf_dir):
    owners = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") == 4, "unmatched").otherwise(F.lower("r_name")).alias("slug"))
    return reports.unmatched_leads(run(spark, sf_dir, standins.POSTINGS), owners)


@query("counts_in_one_row", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM pages) AS pages")
def counts_in_one_row(spark, sf_dir):
    return reports.counts_in_one_row({"orders": table(spark, sf_dir, "orders"), "events": table(spark, sf_dir, "events"), "pages": table(spark, sf_dir, "pages")})


_CONFIG = "SELECT s_suppkey AS id, 'board_' || CAST(s_suppkey % 9 AS STRING) AS token, s_suppkey % 3 AS shape, s_nationkey AS company_id FROM supplier"


def _configs(spark, sf_dir) -> DataFrame:
    """Sources whose config has its keys in no order: a board with a secret, a site, or neither."""
    c = run(spark, sf_dir, _CONFIG)
    token = F.col("token")
    board = F.create_map(F.lit("region"), F.lit("eu"), F.lit("board_token"), token, F.lit("api_token"), F.lit("s3cret"))
    site = F.create_map(F.lit("site"), token, F.lit("board_name"), F.lit(""))
    return c.withColumn("config", F.when(c["shape"] == 0, board).when(c["shape"] == 1, site).otherwise(F.create_map(F.lit("zone"), token))).withColumn("adapter", F.lit("lever"))


@query("source_configs", with_(c=_CONFIG) + """SELECT id, CASE shape WHEN 0 THEN '{"api_token":"s3cret","board_token":"' || token || '","region":"eu"}' WHEN 1 THEN '{"board_name":"","site":"' || token || '"}' ELSE '{"zone":"' || token || '"}' END AS canonical,
CASE shape WHEN 0 THEN 'board_token=' || token WHEN 1 THEN 'site=' || token END AS identity, shape = 0 AS has_secret FROM c""")
def source_configs(spark, sf_dir):
    rows = _configs(spark, sf_dir)
    hidden = F.coalesce(F.try_element_at(reports.redacted(F.col("config")), F.lit("api_token")) == "***", F.lit(False))
    return rows.select("id", reports.canonical_config(F.col("config")).alias("canonical"), reports.config_identity(F.col("config")).alias("identity"), hidden.alias("has_secret"))


@query("source_of_config", with_(c=_CONFIG) + "SELECT id FROM c WHERE company_id = (SELECT company_id FROM c WHERE id = 4) AND shape = 1 AND token = 'board_4'")
def source_of_config(spark, sf_dir):
    rows = _configs(spark, sf_dir)
    own = rows.filter("id = 4").first()["company_id"]
    return reports.find_source(rows, own, "lever", F.create_map(F.lit("board_name"), F.lit(""), F.lit("site"), F.lit("board_4"))).select("id")


@query("company_tags", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'geo:n' || c_nationkey || ',sector:' || lower(c_mktsegment) WHEN 1 THEN 'watch:yes' WHEN 3 THEN '' END AS tags FROM customer""")
def company_tags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 4
    sector, geo = F.concat(F.lit(" Sector:"), "c_mktsegment"), F.concat(F.lit("geo:N"), F.col("c_nationkey").cast("string"), F.lit(" "))
    tags = F.when(kind == 0, F.array(sector, geo, sector)).when(kind == 1, F.array(F.lit("WATCH:yes"), F.lit(" "))).when(kind == 2, F.array(geo, F.lit("colour:red"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("c_custkey").alias("id"), F.array_join(reports.clean_tags(tags), ",").alias("tags"))


@query("seeded_sources", with_(**_REG) + "SELECT company_id, adapter, count(*) AS n, min(id) AS first FROM (SELECT id, company_id, adapter FROM sources UNION ALL SELECT 1000 + n_nationkey, n_nationkey, 'ashby' FROM nation WHERE n_nationkey NOT IN (SELECT company_id FROM sources WHERE adapter = 'ashby')) GROUP BY 1, 2")
def seeded_sources(spark, sf_dir):
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_nationkey").alias("company_id"), F.lit("ashby").alias("adapter"))
    rows = reports.inserted_if_absent(_sources(spark, sf_dir), new, ["company_id", "adapter"])
    return rows.groupBy("company_id", "adapter").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("switched_sources", with_(**_REG) + """SELECT id, CASE WHEN id = 3 THEN false WHEN id = 9 THEN true WHEN id = 5 THEN false ELSE enabled END AS enabled, CASE WHEN id IN (5, 9) THEN 0 ELSE consecutive_failures END AS consecutive_failures,
CASE id WHEN 3 THEN 'disabled' WHEN 5 THEN 'retired' ELSE last_status END AS last_status, CASE WHEN id <> 9 THEN last_error END AS last_error FROM sources""")
def switched_sources(spark, sf_dir):
    rows = reports.with_enabled(_sources(spark, sf_dir), 3, False)
    rows = reports.with_enabled(reports.with_enabled(rows, 9, True), 5, False, retired=True)
    return rows.select("id", "enabled", "consecutive_failures", "last_status", "last_error")


@query("company_status_set", with_(**_REG) + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN id = 1 THEN 'blacklisted' ELSE status END AS status FROM owners) GROUP BY 1")
def company_status_set(spark, sf_dir):
    return reports.with_company_status(_owners(spark, sf_dir), 1, "blacklisted").groupBy("status").agg(F.count("*").alias("n"))


@query("deleted_source", with_(postings=standins.POSTINGS, **_REG) + "SELECT (SELECT count(*) FROM sources WHERE id <> 6) AS sources, (SELECT count(*) FROM postings WHERE source_id <> 6) AS postings, (SELECT count(*) FROM postings WHERE source_id = 6) AS postings_deleted")
def deleted_source(spark, sf_dir):
    sources, postings, gone = reports.without_source(_sources(spark, sf_dir), run(spark, sf_dir, standins.POSTINGS), 6)
    return reports.counts_in_one_row({"sources": sources, "postings": postings}).join(gone)


@query("source_health", with_(**_REG) + """, o AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'timeout' ELSE 'schema_error' END AS status FROM supplier WHERE s_suppkey % 8 <> 7),
f AS (SELECT s.*, o.status, CASE WHEN o.status IN ('ok', 'empty') THEN 0 WHEN o.status IN ('timeout', 'schema_error') THEN consecutive_failures + 1 ELSE consecutive_failures END AS failures FROM sources s LEFT JOIN o USING (id))
SELECT id, CAST(failures AS INT) AS consecutive_failures, enabled AND NOT coalesce(status IN ('timeout', 'schema_error') AND failures >= 2, false) AS enabled, coalesce(status, last_status) AS last_status,
CASE WHEN status IN ('ok', 'empty') THEN NULL WHEN status IS NULL THEN last_error ELSE 'got ' || status END AS last_error FROM f""")
def source_health(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 8 <> 7")
    kind = F.col("s_suppkey") % 6
    status = F.when(kind == 0, "ok").when(kind == 1, "empty").when(kind == 2, "rate_limited").when(kind == 3, "timeout").otherwise("schema_error")
    outcomes = s.select(F.col("s_suppkey").alias("source_id"), status.alias("status"), F.concat(F.lit("got "), status).alias("error"), F.lit("2024-01-02").cast("timestamp").alias("run_at"))
    rows = ingest.source_health(_sources(spark, sf_dir).withColumn("last_run_at", F.lit(None).cast("timestamp")), outcomes, disable_at=2)
    return rows.select("id", F.col("consecutive_failures").cast("int").alias("consecutive_failures"), "enabled", "last_status", "last_error")


@query("error_statuses", """SELECT code, CASE split_part(code, '_', 1) WHEN 'http' THEN 'http_error' WHEN 'schema' THEN 'schema_error' WHEN 'timeout' THEN 'timeout' WHEN 'rate' THEN 'rate_limited' WHEN 'circuit' THEN 'circuit_open' WHEN 'odd' THEN 'error' ELSE 'ok' END AS status, count(*) AS n
FROM (SELECT CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'http_' || event_id % 5 WHEN 'signup' THEN 'timeout_read' WHEN 'purchase' THEN 'rate_limit' ELSE CASE event_id % 3 WHEN 0 THEN 'schema_' || user_id % 3 WHEN 1 THEN 'circuit_open' ELSE 'odd_one' END END AS code FROM events) GROUP BY 1, 2""")
def error_statuses(spark, sf_dir):
    e = F.col("event_id")
    other = F.when(e % 3 == 0, F.concat(F.lit("schema_"), (F.col("user_id") % 3).cast("string"))).when(e % 3 == 1, "circuit_open").otherwise("odd_one")
    code = F.when(F.col("event_type") == "view", F.lit(None).cast("string")).when(F.col("event_type") == "click", F.concat(F.lit("http_"), (e % 5).cast("string"))).when(F.col("event_type") == "signup", "timeout_read").when(F.col("event_type") == "purchase", "rate_limit").otherwise(other)
    return table(spark, sf_dir, "events").select(code.alias("code")).groupBy("code", ingest.status_of_error(F.col("code")).alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs

RUNS = """
SELECT event_id AS id, 'discovery' AS run_type, ts AS started_at, user_id % 7 * 60 + 5 AS seconds, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
  event_id % 4 AS extracted, event_id % 3 AS hits, value AS cost
FROM events
"""


def _runs(spark, sf_dir) -> DataFrame:
    r = run(spark, sf_dir, RUNS).withColumn("started_at", F.col("started_at").cast("timestamp"))
    stats = F.to_json(F.struct(F.round(F.col("cost"), 2).cast("decimal(18,2)").alias("llm_cost_inr"), "extracted", F.col("hits").alias("cache_hits"), F.col("hits").alias("extract_cache_hits"), F.col("extracted").alias("llm_calls")))
    results = F.to_json(F.transform(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int")), lambda i: F.struct(i.cast("long").alias("source_id"), (F.col("id") * 10 + i).alias("fetched"))))
    finished = F.col("started_at") + F.make_dt_interval(secs=F.col("seconds"))
    return r.select("id", "run_type", "started_at", finished.alias("finished_at"), "status", stats.alias("stats"), results.alias("source_results"))


def _latest(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max("started_at").alias("as_of"))))


@query("newest_runs", with_(r=RUNS) + "SELECT id, status FROM r ORDER BY started_at DESC, id DESC LIMIT 20")
def newest_runs(spark, sf_dir):
    return reports.newest_runs(_runs(spark, sf_dir), 20).select("id", "status")


@query("stranded_runs", with_(r=RUNS) + "SELECT id, CASE WHEN status = 'running' AND started_at <= TIMESTAMP '2024-01-20 00:00:00' THEN 'failed' ELSE status END AS status FROM r")
def stranded_runs(spark, sf_dir):
    return ingest.stranded_runs(_runs(spark, sf_dir), F.lit("2024-01-20 01:00:00").cast("timestamp"), 3600).select("id", "status")


@query("run_log_rows", with_(res=standins.RESULTS) + "SELECT 'r1' AS id, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, CAST(sum(fetched) AS BIGINT) AS fetched, 120 AS seconds FROM res")
def run_log_rows(spark, sf_dir):
    stats = reports.folded_results(run(spark, sf_dir, standins.RESULTS))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = reports.run_log_row(stats, "r1", start, start + F.make_dt_interval(secs=F.lit(120)))
    of = lambda name: F.get_json_object("stats", f"$.{name}").cast("long")
    return row.select("id", of("sources_total").alias("total"), of("sources_ok").alias("ok"), of("fetched").alias("fetched"), (F.unix_seconds("finished_at") - F.unix_seconds("started_at")).cast("int").alias("seconds"))


@query("skipped_by_reason", "SELECT CAST(ts AS DATE) AS day, reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT ts, 'no_description' AS reason, event_id % 3 AS n FROM events UNION ALL SELECT ts, event_type, event_id % 4 FROM events) GROUP BY 1, 2")
def skipped_by_reason(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.to_date("ts").alias("day"), F.create_map(F.lit("no_description"), F.col("event_id") % 3, F.col("event_type"), F.col("event_id") % 4).alias("skipped"))
    return reports.skipped_by_reason(rows, ("day",))


_WEEK = "started_at > (SELECT max(started_at) FROM r) - INTERVAL 7 DAY"


@query("duration_trend", with_(r=RUNS) + f"SELECT CAST(started_at AS DATE) AS day, CAST(seconds AS BIGINT) AS seconds, status, CAST(id % 3 + 1 AS INT) AS sources_attempted, count(*) AS n FROM r WHERE {_WEEK} GROUP BY ALL")
def duration_trend(spark, sf_dir):
    return reports.duration_trend(_latest(_runs(spark, sf_dir)), F.col("as_of"), 7).groupBy("day", "seconds", "status", "sources_attempted").agg(F.count("*").alias("n"))


@query("daily_json_totals", with_(r=RUNS) + f"""SELECT CAST(started_at AS DATE) AS day, CAST(sum(CAST(round(cost, 2) AS DECIMAL(18,2))) AS DOUBLE) AS inr, CAST(sum(extracted) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS cache_hits, CAST(sum(extracted) AS BIGINT) AS extracted FROM r WHERE {_WEEK} GROUP BY 1""")
def daily_json_totals(spark, sf_dir):
    rows = reports.daily_model_totals(_latest(_runs(spark, sf_dir)), F.col("as_of"), 7)
    return rows.select("day", F.col("inr").cast("double").alias("inr"), "calls", "cache_hits", "extracted")


@query("cost_per_posting", with_(r=RUNS) + f"SELECT CAST(started_at AS DATE) AS day, count(*) AS n, count(*) FILTER (extracted = 0) AS without, round(sum(CASE WHEN extracted > 0 THEN round(CAST(round(cost, 2) AS DOUBLE) / extracted + 1e-9, 3) END), 2) AS inr FROM r WHERE {_WEEK} GROUP BY 1")
def cost_per_posting(spark, sf_dir):
    rows = reports.cost_per_posting(_latest(_runs(spark, sf_dir)), F.col("as_of"), 7)
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("inr_per_posting").isNull()).alias("without"), F.round(F.sum(F.col("inr_per_posting").cast("double")), 2).alias("inr"))


@query("cache_hit_rates", with_(r=RUNS) + f"SELECT id % 12 AS k, count(*) AS n, max(round(hits * 100.0 / nullif(extracted, 0), 1)) AS hit_pct FROM r WHERE {_WEEK} GROUP BY 1")
def cache_hit_rates(spark, sf_dir):
    rows = reports.cache_hits(_latest(_runs(spark, sf_dir)), F.col("as_of"), 7)
    # the remainders by 3 and 4 say the remainder by 12
    k = (F.col("extracted") * 9 + F.col("cache_hits") * 4) % 12
    return rows.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.max(F.col("hit_pct").cast("double")).alias("hit_pct"))


@query("result_of_source", "SELECT event_id AS id, CASE WHEN event_id % 3 >= 1 THEN event_id * 10 + 2 END AS fetched FROM events")
def result_of_source(spark, sf_dir):
    return reports.result_of(_runs(spark, sf_dir), 2).select("id", F.col("result.fetched").alias("fetched"))


# ---------------------------------------------------------------- fetching

#: Attempts of a downloader: a bucket per user, four events to a request, statuses by type and value.
ATTEMPTS = """
SELECT user_id % 20 AS bucket, 1 AS run_id, CAST(floor(event_id / 4) AS BIGINT) AS request, CAST(event_id % 4 AS INT) AS attempt,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'signup' THEN NULL WHEN 'purchase' THEN 429 ELSE 404 END AS status
FROM (SELECT event_id, event_type, first_value(user_id) OVER (PARTITION BY CAST(floor(event_id / 4) AS BIGINT) ORDER BY event_id) AS user_id FROM events) e
"""
_FETCHED = with_(a=ATTEMPTS, r="SELECT bucket, request, count(*) AS attempts, arg_max(coalesce(status, -1), attempt) AS last FROM a GROUP BY 1, 2") + """, f AS (SELECT bucket, request, attempts, nullif(last, -1) AS status,
CASE WHEN last BETWEEN 200 AND 299 THEN 'ok' WHEN last IN (-1, 503, 429) THEN CASE WHEN attempts >= 4 THEN 'exhausted' ELSE 'given_up' END ELSE 'refused' END AS outcome FROM r) """


def _requests(spark, sf_dir) -> DataFrame:
    return fetching.requests(run(spark, sf_dir, ATTEMPTS))


@query("fetch_outcomes", _FETCHED + "SELECT bucket, request, attempts - 1 AS retries, status, outcome FROM f")
def fetch_outcomes(spark, sf_dir):
    return _requests(spark, sf_dir).select("bucket", "request", "retries", "status", "outcome")


@query("fetch_breaker", _FETCHED + """, s AS (SELECT *, sum(CASE outcome WHEN 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY bucket ORDER BY request) AS streak, CASE WHEN status IS NULL OR status >= 500 THEN 1 ELSE 0 END AS failed FROM f),
c AS (SELECT *, sum(failed) OVER (PARTITION BY bucket, streak ORDER BY request) AS failures FROM s)
SELECT bucket, request, CAST(failures AS BIGINT) AS failures, coalesce(max(failures) OVER (PARTITION BY bucket ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 5, false) AS short_circuited FROM c""")
def fetch_breaker(spark, sf_dir):
    return fetching.breaker(_requests(spark, sf_dir), 5).select("bucket", "request", F.col("failures").cast("long").alias("failures"), "short_circuited")


@query("repaired_answers", "SELECT l_orderkey AS posting_id, min(l_linenumber - 1) FILTER (l_linenumber <= 3 AND l_discount >= 0.05) IS NOT NULL AS ok, CAST(coalesce(min(l_linenumber - 1) FILTER (l_linenumber <= 3 AND l_discount >= 0.05), max(l_linenumber - 1) FILTER (l_linenumber <= 3)) AS INT) AS repairs FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber <= 3) > 0")
def repaired_answers(spark, sf_dir):
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("posting_id"), (F.col("l_linenumber") - 1).alias("attempt"), F.col("l_discount").alias("answer"))
    rows = fetching.repaired(answers, F.col("answer") >= 0.05)
    return rows.select("posting_id", (F.col("outcome") == "ok").alias("ok"), F.col("repairs").cast("int").alias("repairs"))


@query("coalesced_fires", """WITH w AS (SELECT user_id AS job, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, lag(CAST(epoch_us(ts) // 1000000 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
SELECT job, s, s // 3600 - p // 3600 AS coalesced, s % 3600 <= 900 AS runs FROM w WHERE s // 3600 > p // 3600""")
def coalesced_fires(spark, sf_dir):
    moments = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"))
    return fetching.fires(moments, 60, 900).select("job", F.unix_seconds("at").alias("s"), "coalesced", "runs")


# ---------------------------------------------------------------- claims and artifacts

CLAIMS = """
SELECT o_orderkey AS id, 'claim-' || CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS expires_at, o_orderdate AS verified_at,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS deleted_at FROM orders
"""
ARTIFACTS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'resume' ELSE 'cover_letter' END AS kind, o_orderdate AS generated_at, o_custkey AS posting_id, o_custkey AS application_id, o_orderkey % 5 <> 0 AS validated FROM orders
"""
USAGE = "SELECT DISTINCT l_orderkey AS artifact_id, l_partkey AS claim_id FROM lineitem"
LETTERS = "SELECT c_custkey AS id, c_custkey * 2 AS resume_artifact_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 2 ELSE c_custkey * 2 + 1 END AS cover_letter_artifact_id, c_mktsegment AS status FROM customer"
_CLAIMS = dict(claims=CLAIMS, artifacts=ARTIFACTS, used=USAGE, letters=LETTERS, links="SELECT id, status, resume_artifact_id AS artifact FROM letters UNION SELECT id, status, cover_letter_artifact_id FROM letters")


def _claims(spark, sf_dir):
    dated = lambda sql, *names: run(spark, sf_dir, sql).withColumns({n: F.col(n).cast("timestamp") for n in names})
    return dated(CLAIMS, "expires_at", "verified_at", "deleted_at"), dated(ARTIFACTS, "generated_at"), run(spark, sf_dir, USAGE), run(spark, sf_dir, LETTERS)


_NOW = "TIMESTAMP '1998-01-01 00:00:00'"


@query("claims_due", with_(**_CLAIMS) + f"""SELECT id, expires_at < {_NOW} AS expired, expires_at < {_NOW} + INTERVAL 30 DAY AS expiring FROM claims WHERE deleted_at IS NULL AND (coalesce(expires_at < {_NOW} + INTERVAL 30 DAY, false) OR verified_at < {_NOW} - INTERVAL 180 DAY)""")
def claims_due(spark, sf_dir):
    return reports.claims_due(_claims(spark, sf_dir)[0], F.lit("1998-01-01").cast("timestamp")).select("id", "expired", "expiring")


@query("claims_of_artifacts", with_(**_CLAIMS) + "SELECT artifact_id, key, coalesce(expires_at < generated_at, false) AS was_stale FROM used JOIN claims c ON c.id = claim_id JOIN artifacts a ON a.id = artifact_id")
def claims_of_artifacts(spark, sf_dir):
    claims, artifacts, used, _ = _claims(spark, sf_dir)
    return reports.claims_of_artifact(used, claims, artifacts).select("artifact_id", "key", "was_stale")


@query("claims_of_applications", with_(**_CLAIMS) + f"SELECT l.id AS application_id, c.key, a.id AS artifact_id, coalesce(c.expires_at < {_NOW}, false) AS expired_now FROM links l JOIN artifacts a ON a.id = l.artifact JOIN used u ON u.artifact_id = a.id JOIN claims c ON c.id = u.claim_id")
def claims_of_applications(spark, sf_dir):
    claims, artifacts, used, letters = _claims(spark, sf_dir)
    return reports.claims_of_application(letters, used, claims, artifacts, F.lit("1998-01-01").cast("timestamp")).select("application_id", "key", "artifact_id", "expired_now")


@query("claim_uses", with_(**_CLAIMS) + "SELECT u.claim_id, u.artifact_id, a.kind, l.id AS application_id, l.status AS application_status FROM used u JOIN artifacts a ON a.id = u.artifact_id LEFT JOIN links l ON a.id = l.artifact")
def claim_uses(spark, sf_dir):
    _, artifacts, used, letters = _claims(spark, sf_dir)
    return reports.claim_uses(used, artifacts, letters).select("claim_id", "artifact_id", "kind", "application_id", "application_status")


@query("invalid_artifacts", with_(**_CLAIMS) + "SELECT application_id, string_agg(label, ', ' ORDER BY label) AS offending FROM (SELECT application_id, id || ' (' || kind || ')' AS label FROM artifacts WHERE NOT validated) GROUP BY 1")
def invalid_artifacts(spark, sf_dir):
    return reports.invalid_artifacts(_claims(spark, sf_dir)[1])


# ---------------------------------------------------------------- requirements

#: Nouns of parts are skills; some of the adjectives make aliases.
VOCABULARY = Vocabulary("v7", tuple(Skill(n, n.title(), "hardware" if n != "rod" else "other", (f"hot {n}", f"cold {n}")) for n in ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")))
_ASKED = """SELECT l_orderkey AS posting_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos,
  CASE l_returnflag WHEN 'R' THEN 'hard' WHEN 'A' THEN 'nice' ELSE 'tool' END AS kind, p_name AS text, CASE WHEN l_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) END AS hint, l_discount * 10 AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey"""
#: What the vocabulary makes of a phrase, in SQL.
_EXACT = "CASE WHEN split_part({0}, ' ', 1) IN ('hot', 'cold') THEN split_part({0}, ' ', 2) WHEN {0} IN ('ring', 'widget', 'bolt', 'gear', 'gizmo', 'plate', 'anvil', 'rod') THEN {0} END"


def _answers(spark, sf_dir) -> DataFrame:
    """One extraction per order, its phrases in capitals or with stray blanks."""
    rows = run(spark, sf_dir, _ASKED)
    shown = F.when(F.col("pos") % 2 == 0, F.upper("text")).otherwise(F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))))
    entry = F.struct("pos", F.struct("kind", shown.alias("text"), F.col("hint").alias("normalised_skill_hint"), F.col("weight").cast("double").alias("weight"), F.col("pos").cast("int").alias("ordinal")).alias("r"))
    lists = rows.groupBy("posting_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias("requirements"))
    return lists.select("posting_id", F.struct("requirements", F.lit(None).cast("string").alias("notes")).alias("answer"))


_PREPARED = with_(asked=_ASKED, first="SELECT *, row_number() OVER (PARTITION BY posting_id, text ORDER BY pos) AS r FROM asked") + f""", kept AS (
SELECT posting_id, kind, coalesce({_EXACT.format('text')}, {_EXACT.format('hint')}) AS normalised_skill, hint, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY pos) - 1 AS INT) AS ordinal FROM first WHERE r = 1) """


@query("prepared_requirements", _PREPARED + "SELECT posting_id, kind, normalised_skill, hint AS normalised_skill_hint, ordinal FROM kept")
def prepared_requirements(spark, sf_dir):
    return requirements.prepared(_answers(spark, sf_dir), VOCABULARY).select("posting_id", "kind", "normalised_skill", "normalised_skill_hint", F.col("ordinal").cast("int").alias("ordinal"))


@query("valid_extractions", with_(asked=_ASKED) + "SELECT posting_id, bool_and(weight BETWEEN 0.25 AND 1.0) AS valid FROM asked GROUP BY 1")
def valid_extractions(spark, sf_dir):
    return _answers(spark, sf_dir).select("posting_id", requirements.valid_extraction(F.col("answer")).alias("valid"))


@query("extraction_rollup", _PREPARED + "SELECT count(DISTINCT posting_id) AS postings, count(*) AS requirements, count(normalised_skill) AS resolved, count(*) - count(normalised_skill) AS unresolved, CAST(0 AS BIGINT) AS empty_postings FROM kept")
def extraction_rollup(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return requirements.extraction_summary(answers, requirements.prepared(answers, VOCABULARY))


_STORED = with_(asked=_ASKED) + f""", before AS (SELECT *, CASE pos % 3 WHEN 0 THEN {_EXACT.format('text')} WHEN 1 THEN 'saw' END AS was, coalesce({_EXACT.format('text')}, {_EXACT.format('hint')}) AS now, posting_id % 2 = 0 AS old FROM asked),
told AS (SELECT posting_id, pos, now, CASE WHEN now IS NULL AND was IS NOT NULL AND hint IS NULL THEN 'unrecoverable' WHEN was IS NULL AND now IS NOT NULL THEN 'gained' WHEN was IS NOT NULL AND now IS NULL THEN 'lost' WHEN was <> now THEN 'changed' WHEN old THEN 'rebound' ELSE 'same' END AS outcome FROM before) """


def _reresolved(spark, sf_dir) -> DataFrame:
    rows = run(spark, sf_dir, _ASKED).withColumnRenamed("hint", "normalised_skill_hint")
    alias = F.when(F.split_part("text", F.lit(" "), F.lit(1)).isin("hot", "cold"), F.split_part("text", F.lit(" "), F.lit(2)))
    was = F.when(F.col("pos") % 3 == 0, alias).when(F.col("pos") % 3 == 1, "saw")
    version = F.when(F.col("posting_id") % 2 == 0, "extract.v1+v6").otherwise("extract.v1+v7")
    return requirements.reresolved(rows.withColumn("normalised_skill", was).withColumn("prompt_version", version), VOCABULARY)


@query("reresolution_outcomes", _STORED + "SELECT posting_id, pos, now AS after, outcome FROM told")
def reresolution_outcomes(spark, sf_dir):
    return _reresolved(spark, sf_dir).select("posting_id", "pos", "after", "outcome")


@query("reresolution_counts", _STORED + """SELECT count(*) AS examined, count(*) FILTER (outcome = 'gained') AS gained, count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'unrecoverable') AS unrecoverable,
CAST(0 AS BIGINT) AS by_containment, count(*) FILTER (outcome IN ('gained', 'lost', 'changed', 'rebound')) AS rewritten FROM told""")
def reresolution_counts(spark, sf_dir):
    return requirements.reresolution_counts(_reresolved(spark, sf_dir))


@query("rebound_versions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'extract.v' || p_size || '+v7' ELSE 'score.v1+' || p_brand || '+v7' END AS version FROM part")
def rebound_versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stored = F.when(F.col("p_partkey") % 2 == 0, text.version_string(F.concat(F.lit("extract.v"), F.col("p_size").cast("string")), "v6")).otherwise(text.version_string("score.v1", F.col("p_brand"), "v5"))
    return p.select(F.col("p_partkey").alias("id"), rebound_version(stored, VOCABULARY).alias("version"))


@query("unresolved_hard_texts", with_(asked=_ASKED) + "SELECT text, count(*) AS n FROM asked WHERE kind = 'hard' AND hint IS NULL GROUP BY 1")
def unresolved_hard_texts(spark, sf_dir):
    return requirements.unresolved_texts(run(spark, sf_dir, _ASKED).withColumn("normalised_skill", F.col("hint")))


@query("boilerplate_delta", with_(docs="SELECT doc_id AS id, doc_id % 3 AS k, CASE doc_id % 4 WHEN 0 THEN 'You have strong Communication Skills' WHEN 1 THEN 'A team player with excellent communication skills' ELSE coalesce(text, '') END AS text FROM documents") + "SELECT id, CASE id % 4 WHEN 0 THEN 'communication skills' ELSE 'excellent communication' END AS phrase, 'condition' AS kind FROM docs WHERE k = 0 AND id % 4 < 2")
def boilerplate_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.when(d["doc_id"] % 4 == 0, "You have strong Communication Skills").when(d["doc_id"] % 4 == 1, "A team player with excellent communication skills").otherwise(F.coalesce("text", F.lit("")))
    skill = F.when(d["doc_id"] % 3 == 1, "sql")
    rows = d.select(F.col("doc_id").alias("id"), body.alias("text"), F.when(d["doc_id"] % 3 == 2, "nice").otherwise("hard").alias("kind"), skill.alias("normalised_skill"))
    return requirements.boilerplate_delta(rows, ("communication skills", "excellent communication", "team player")).select("id", "phrase", "kind")


@query("requirements_replaced", with_(asked=_ASKED) + "SELECT posting_id, text, count(*) AS n FROM asked WHERE posting_id % 10 <> 0 GROUP BY 1, 2 UNION ALL SELECT posting_id, upper(text), count(*) FROM asked WHERE posting_id % 10 = 0 GROUP BY 1, 2")
def requirements_replaced(spark, sf_dir):
    stored = run(spark, sf_dir, _ASKED).select("posting_id", "text")
    new = stored.filter("posting_id % 10 = 0").select("posting_id", F.upper("text").alias("text"))
    return requirements.replaced(stored, new, ["posting_id"]).groupBy("posting_id", "text").agg(F.count("*").alias("n"))


@query("resolution_rates", with_(asked=_ASKED) + "SELECT kind, count(*) AS n, count(hint) AS resolved, round(count(hint) / count(*), 9) AS share FROM asked GROUP BY 1")
def resolution_rates(spark, sf_dir):
    rows = run(spark, sf_dir, _ASKED).withColumn("normalised_skill", F.col("hint"))
    return diagnostics.resolution_rates(rows).withColumn("share", F.round("share", 9))


@query("top_skills", with_(asked=_ASKED) + "SELECT hint AS normalised_skill, count(*) AS n FROM asked WHERE hint IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_skills(spark, sf_dir):
    return diagnostics.top_skills(run(spark, sf_dir, _ASKED).withColumn("normalised_skill", F.col("hint")), 5)


@query("postings_by_version", "SELECT l_returnflag || '+' || l_linestatus AS prompt_version, count(DISTINCT l_orderkey) AS postings FROM lineitem GROUP BY 1")
def postings_by_version(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("posting_id"), text.version_string(F.col("l_returnflag"), F.col("l_linestatus")).alias("prompt_version"))
    return diagnostics.postings_by_version(rows)


# ---------------------------------------------------------------- variants

#: Bullets of variants: a nation's skills by its suppliers' parts; every third bullet is untagged.
BULLETS = """
SELECT s_nationkey % 6 AS variant_id, s_suppkey AS n, 'b' || CAST(s_suppkey AS STRING) AS bullet_id, 'Shipped ' || p_name || ' ' || CAST(p_size AS STRING) AS text,
  CASE WHEN s_suppkey % 3 <> 0 THEN split_part(p_name, ' ', 2) END AS skill, CASE WHEN s_suppkey % 5 = 0 THEN 'claim-' || CAST(s_suppkey % 15 AS STRING) END AS claim, s_suppkey % 2 = 0 AS of_project
FROM supplier JOIN part ON p_partkey = s_suppkey
"""
#: Items of skills lines: with a version, a slash, brackets, or a name that nothing knows.
ITEMS = """
SELECT DISTINCT s_nationkey % 6 AS variant_id, split_part(p_name, ' ', 2) AS noun, s_suppkey % 4 AS shape FROM supplier JOIN part ON p_partkey = s_suppkey
"""
_SHOWN = "CASE shape WHEN 0 THEN noun || ' v2.1' WHEN 1 THEN 'Unheard / hot ' || noun WHEN 2 THEN 'Metal (cold ' || noun || ', iron)' ELSE 'Unheard ' || noun END"
_KNOWN = "CASE WHEN shape < 3 THEN noun END"
_PROFILE = dict(bullets=BULLETS, items=ITEMS)


def _profiles(spark, sf_dir) -> DataFrame:
    kinds = "array<struct<id:string,text:string,skills:array<string>,claim_keys:array<string>>>"
    b = run(spark, sf_dir, BULLETS)
    one = F.struct("n", F.struct(F.col("bullet_id").alias("id"), "text", F.array_compact(F.array("skill")).alias("skills"), F.array_compact(F.array("claim")).alias("claim_keys")).alias("b"))
    gathered = lambda mine: F.transform(F.array_sort(F.collect_list(F.when(mine, one))), lambda e: e["b"]).cast(kinds)
    shown = b.groupBy("variant_id").agg(gathered(~F.col("of_project")).alias("work"), gathered(F.col("of_project")).alias("project"))
    lines = run(spark, sf_dir, ITEMS).withColumn("item", F.expr(_SHOWN)).groupBy("variant_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    content = F.struct(
        F.array(F.struct(F.array(F.struct(F.col("work").alias("bullets"))).alias("blocks"))).alias("experience"),
        F.array(F.struct(F.col("project").alias("bullets"))).alias("projects"),
        F.array(F.struct(F.lit("Tools").alias("label"), "items")).alias("skills"),
    )
    return shown.join(lines, "variant_id", "left").select(F.col("variant_id").alias("id"), content.alias("content"))


@query("profile_bullets", with_(**_PROFILE) + "SELECT variant_id, CAST(row_number() OVER (PARTITION BY variant_id ORDER BY of_project, n) - 1 AS INT) AS position, bullet_id, text, skill FROM bullets")
def profile_bullets(spark, sf_dir):
    return variants.bullets(_profiles(spark, sf_dir)).select("variant_id", "position", "bullet_id", "text", F.try_element_at("skills", F.lit(1)).alias("skill"))


@query("variant_skill_sets", with_(**_PROFILE, d=f"SELECT variant_id, list_sort(list(DISTINCT {_KNOWN}) FILTER ({_KNOWN} IS NOT NULL)) AS declared FROM items GROUP BY 1", p="SELECT variant_id, list_sort(list(DISTINCT skill) FILTER (skill IS NOT NULL)) AS proven FROM bullets GROUP BY 1") + """
SELECT variant_id, array_to_string(coalesce(declared, []), ',') AS declared, array_to_string(coalesce(proven, []), ',') AS proven, array_to_string(list_sort(list_distinct(list_concat(coalesce(declared, []), coalesce(proven, [])))), ',') AS skill_set,
array_to_string(list_sort(list_filter(coalesce(declared, []), lambda t: NOT list_contains(coalesce(proven, []), t))), ',') AS unproven FROM d FULL JOIN p USING (variant_id)""")
def variant_skill_sets(spark, sf_dir):
    rows = variants.skill_sets(_profiles(spark, sf_dir), VOCABULARY)
    return rows.select("variant_id", *(F.array_join(c, ",").alias(c) for c in ("declared", "proven", "skill_set", "unproven")))


@query("unresolved_items", with_(**_PROFILE) + f"SELECT DISTINCT variant_id, {_SHOWN} AS item FROM items WHERE {_KNOWN} IS NULL")
def unresolved_items(spark, sf_dir):
    return variants.unresolved_items(_profiles(spark, sf_dir), VOCABULARY)


@query("untagged_bullets", with_(**_PROFILE) + "SELECT variant_id, bullet_id FROM bullets WHERE skill IS NULL")
def untagged_bullets(spark, sf_dir):
    return variants.untagged_bullets(_profiles(spark, sf_dir))


@query("tag_problems", with_(**_PROFILE) + """SELECT variant_id, bullet_id, 'unknown skill' AS problem, skill AS value FROM bullets WHERE skill IN ('gizmo', 'rod')
UNION ALL SELECT variant_id, bullet_id, 'claim not approved', claim FROM bullets WHERE claim = 'claim-5'""")
def tag_problems(spark, sf_dir):
    skills = VOCABULARY.skill_table(spark).filter("token not in ('gizmo', 'rod')")
    claims = table(spark, sf_dir, "supplier").select(F.concat(F.lit("claim-"), (F.col("s_suppkey") % 15).cast("string")).alias("key"), F.when(F.col("s_suppkey") % 15 == 5, "no").otherwise("Yes").alias("verdict"))
    return variants.tag_problems(_profiles(spark, sf_dir), skills, variants.approved_claims(claims))


@query("tag_file_problems", with_(**_PROFILE) + "SELECT bullet_id, 'text changed' AS problem FROM bullets WHERE n % 4 = 1 UNION ALL SELECT 'x' || CAST(n AS STRING), 'unknown bullet' FROM bullets WHERE n % 4 = 3")
def tag_file_problems(spark, sf_dir):
    b = run(spark, sf_dir, BULLETS)
    n = F.col("n") % 4
    tags = b.select(F.when(n == 3, F.concat(F.lit("x"), F.col("n").cast("string"))).otherwise(F.col("bullet_id")).alias("bullet_id"), F.when(n == 1, F.concat(F.lit("Once "), "text")).when(n == 0, F.left("text", F.lit(9))).otherwise(F.col("text")).alias("text"))
    return variants.tag_file_problems(tags, _profiles(spark, sf_dir))


@query("tagged_bullets", with_(**_PROFILE) + "SELECT variant_id, bullet_id, CASE WHEN n % 2 = 1 THEN 'tagged' ELSE skill END AS skill FROM bullets")
def tagged_bullets(spark, sf_dir):
    tags = run(spark, sf_dir, BULLETS).filter("n % 2 = 1").select("bullet_id", F.array(F.lit("tagged")).alias("skills"), F.array().cast("array<string>").alias("claims"))
    rows = variants.bullets(variants.with_tags(_profiles(spark, sf_dir), tags))
    return rows.select("variant_id", "bullet_id", F.try_element_at("skills", F.lit(1)).alias("skill"))


# ---------------------------------------------------------------- matching and evaluation


#: Names with equal sets of trigrams are equally like a lead; the smallest id of them is its company.
_ALIKE = "SELECT c_custkey, c_name, min(c_custkey) OVER (PARTITION BY list_sort(list_distinct(flatten(list_transform(string_split(lower(replace(c_name, '#', ' ')), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3))))))) AS best FROM customer"


@query("resolved_leads", with_(alike=_ALIKE) + """SELECT o_orderkey AS external_id, CASE o_orderkey % 3 WHEN 0 THEN (SELECT max(c_custkey) + 1 FROM customer) ELSE best END AS company_id FROM orders JOIN alike ON o_custkey = c_custkey""")
def resolved_leads(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("slug"), F.lit("volume").alias("tier"), F.lit("tracking").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"))
    companies = matching.with_reserved_company(c)
    orders = table(spark, sf_dir, "orders").join(c.select(F.col("id").alias("o_custkey"), F.col("name").alias("c_name")), "o_custkey")
    leads = orders.select(F.col("o_orderkey").alias("external_id"), F.when(F.col("o_orderkey") % 3 == 0, "Acme").otherwise(F.concat("c_name", F.lit(" Pvt. Ltd."))).alias("company_name"))
    return matching.resolved_leads(leads, companies)


_GRAMS = "list_distinct(flatten(list_transform(string_split('large ring', ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"


@query("trigram_suggestions", f"""WITH g AS (SELECT p_partkey AS id, {_GRAMS} AS a, {_GRAMS.replace("'large ring'", "p_name")} AS b FROM part)
SELECT id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS similarity FROM g WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.3 ORDER BY similarity DESC, id LIMIT 25""")
def trigram_suggestions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return matching.suggestions("large ring", parts, most=25).select("id", F.round("similarity", 9).alias("similarity"))


_GATED = "SELECT l_linenumber AS k, avg(CASE WHEN l_returnflag = 'N' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS rate, count(*) AS n FROM lineitem GROUP BY 1"
_GATE_ROWS = "(VALUES ('hard_recall', 0.90, true, 1), ('hard_precision', 0.85, true, 2), ('kind_accuracy', 0.88, true, 3), ('normalisation_accuracy', 0.95, true, 4), ('coverage_kappa', 0.70, true, 5), ('ranking_rho', 0.75, true, 6), ('grounding_violations', 0.0, false, 7)) AS g(name, threshold, up, k)"
#: Metrics around their thresholds, by the share of a line number's returns.
_METRIC = "CASE k WHEN 5 THEN 0.4 + rate WHEN 7 THEN 0.0 ELSE rate + 0.3 + k * 0.05 END"


def _gates(spark, sf_dir) -> DataFrame:
    names = spark.createDataFrame([(name, i) for i, name in enumerate(GATES, 1)], "name string, k int")
    values = run(spark, sf_dir, _GATED).withColumn("rate", F.col("rate").cast("double")).withColumn("k", F.col("k").cast("int"))
    return values.join(names, "k").filter("k <> 6").select("name", F.expr(_METRIC).cast("double").alias("value"))


@query("evaluation_gates", with_(m=_GATED) + f"""SELECT name, round(coalesce(CASE WHEN g.k <> 6 THEN {_METRIC.replace('CASE k', 'CASE g.k').replace('+ k *', '+ g.k *')} END, 0), 6) AS value,
CASE WHEN up THEN coalesce(CASE WHEN g.k <> 6 THEN {_METRIC.replace('CASE k', 'CASE g.k').replace('+ k *', '+ g.k *')} END, 0) >= threshold ELSE true END AS passed FROM {_GATE_ROWS} LEFT JOIN m ON m.k = g.k""")
def evaluation_gates(spark, sf_dir):
    return evaluation.gates(_gates(spark, sf_dir)).select("name", F.round("value", 6).alias("value"), "passed")


@query("gate_regressions", with_(m=_GATED) + f"SELECT name FROM {_GATE_ROWS} JOIN m ON m.k = g.k WHERE g.k IN (1, 3, 5)")
def gate_regressions(spark, sf_dir):
    rows = evaluation.gates(_gates(spark, sf_dir))
    # the odd ones were better by more than the limit, the others by less, the last one worse
    shift = F.when(F.col("name").isin("hard_recall", "kind_accuracy", "coverage_kappa"), 0.021).when(F.col("name") == "grounding_violations", 0.5).otherwise(0.019)
    return evaluation.regressions(rows, rows.withColumn("value", F.col("value") + shift)).select("name")


@query("slice_shortfalls", "SELECT s AS slice, coalesce(n, 0) AS have, CAST(t AS INT) AS target, coalesce(n, 0) < t AS short FROM (VALUES ('error', 10), ('view', 10000000), ('absent', 1)) AS g(s, t) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = s")
def slice_shortfalls(spark, sf_dir):
    cases = table(spark, sf_dir, "events").select(F.col("event_type").alias("slice"))
    return evaluation.slice_shortfall(cases, {"error": 10, "view": 10_000_000, "absent": 1})


_RATED = "SELECT o_orderkey, o_totalprice, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders"


@query("decile_rates", with_(x=_RATED) + """, r AS (SELECT urgent, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r, count(*) OVER () AS n FROM x)
SELECT CAST(least(10, floor((r - 0.5) * 10 / n) + 1) AS INT) AS decile, count(*) AS n, round(avg(CAST(urgent AS INT)), 9) AS rate FROM r GROUP BY 1""")
def decile_rates(spark, sf_dir):
    rows = evaluation.decile_rates(run(spark, sf_dir, _RATED), "o_totalprice", "urgent")
    return rows.select(F.col("decile").cast("int").alias("decile"), "n", F.round("rate", 9).alias("rate"))


@query("recall_and_precision", """SELECT l_linenumber AS k, round(coalesce(count(*) FILTER (found AND wanted) / nullif(count(*) FILTER (wanted), 0), 1), 9) AS recall, round(coalesce(count(*) FILTER (found AND wanted) / nullif(count(*) FILTER (found), 0), 1), 9) AS precision
FROM (SELECT l_linenumber, l_returnflag = 'R' AND l_linenumber <> 3 AS wanted, l_quantity > 25 AS found FROM lineitem) GROUP BY 1""")
def recall_and_precision(spark, sf_dir):
    found, wanted = F.col("l_quantity") > 25, (F.col("l_returnflag") == "R") & (F.col("l_linenumber") != 3)
    hit = F.count_if(found & wanted)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(scores.ratio(hit, F.count_if(wanted)), 9).alias("recall"), F.round(scores.ratio(hit, F.count_if(found)), 9).alias("precision"))


_QUIET = "SELECT c_custkey AS application_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'dream' WHEN 'MACHINERY' THEN 'strong' ELSE 'volume' END AS tier, CAST(c_custkey % 17 AS INT) AS quiet_days FROM customer"


@query("todays_follow_ups", with_(q=_QUIET) + "SELECT * FROM q ORDER BY CASE tier WHEN 'dream' THEN 0 WHEN 'strong' THEN 1 ELSE 2 END, quiet_days DESC, application_id LIMIT 3")
def todays_follow_ups(spark, sf_dir):
    return funnel.todays_follow_ups(run(spark, sf_dir, _QUIET))


@query("applications_with_status", with_(ev=standins.EVENTS) + """, f AS (SELECT application_id, coalesce(arg_max(status, (occurred_at, id)) FILTER (status IN ('rejected', 'withdrawn')), arg_max(status, (CASE status WHEN 'submitted' THEN 0 WHEN 'acknowledged' THEN 1 WHEN 'screening' THEN 2 WHEN 'interview' THEN 3 WHEN 'offer' THEN 4 ELSE -1 END, occurred_at, id))) AS status FROM ev GROUP BY 1)
SELECT c_custkey AS id, coalesce(f.status, 'submitted') AS status FROM customer LEFT JOIN f ON application_id = c_custkey""")
def applications_with_status(spark, sf_dir):
    applications = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("draft").alias("status"))
    return funnel.with_status(applications, run(spark, sf_dir, standins.EVENTS)).select("id", "status")


# ---------------------------------------------------------------- writes


@query("close_applied", with_(postings=standins.POSTINGS) + "SELECT id, CASE WHEN id % 4 = 0 THEN 2 ELSE missed_runs END AS missed_runs, closed_at IS NOT NULL OR id % 8 = 0 AS closed FROM postings")
def close_applied(spark, sf_dir):
    postings = run(spark, sf_dir, standins.POSTINGS).select("id", "missed_runs", F.col("closed_at").cast("timestamp").alias("closed_at"))
    delta = postings.filter("id % 4 = 0").select("id", F.lit(2).alias("missed_runs"), F.when(F.col("id") % 8 == 0, F.lit("2024-05-01").cast("timestamp")).alias("closed_at"))
    return ingest.apply_close(postings, delta).select("id", "missed_runs", F.col("closed_at").isNotNull().alias("closed"))


@query("screen_applied", with_(postings=standins.POSTINGS) + "SELECT id, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE filtered_out END AS filtered_out, CASE id % 5 WHEN 0 THEN 'title' WHEN 1 THEN NULL ELSE filter_reason END AS filter_reason FROM postings")
def screen_applied(spark, sf_dir):
    postings = run(spark, sf_dir, standins.POSTINGS).select("id", "filtered_out", "filter_reason")
    delta = postings.filter("id % 5 < 2").select("id", (F.col("id") % 5 == 0).alias("filtered_out"), F.when(F.col("id") % 5 == 0, "title").alias("filter_reason"))
    return screen.apply_delta(postings, delta).select("id", "filtered_out", "filter_reason")


@query("scores_replaced", "SELECT o_orderstatus AS version, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END) AS BIGINT) AS total FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0 GROUP BY 1")
def scores_replaced(spark, sf_dir):
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("version"), F.lit(1).alias("score"))
    sinks.replace_partitions(rows, path, "version")
    sinks.replace_partitions(rows.filter("version = 'O' and id % 2 = 0").withColumn("score", F.lit(2)), path, "version")
    return sinks.current(spark, path).groupBy("version").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("table_swapped", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def table_swapped(spark, sf_dir):
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    sinks.swapped(table(spark, sf_dir, "customer"), path)
    sinks.swapped(sinks.current(spark, path).filter("c_custkey % 3 <> 0"), path)  # reads what it replaces
    return sinks.current(spark, path).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scores


@query("evidence_lists", "SELECT l_orderkey AS posting_id, l_suppkey % 3 AS variant_id, string_agg(CAST(l_linenumber AS STRING) || ':b' || CAST(l_partkey AS STRING), ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS evidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def evidence_lists(spark, sf_dir):
    rows = _level_rows(spark, sf_dir)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["requirement_id"].cast("string"), F.lit(":"), e["bullet_ref"])), ",")
    return scoring.evidence(rows).select("posting_id", "variant_id", shown.alias("evidence"))


def _level_rows(spark, sf_dir) -> DataFrame:
    """Levels by return flag: R met, A partial, N missing; kinds by line status."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    level = F.when(F.col("l_returnflag") == "R", "met").when(F.col("l_returnflag") == "A", "partial").otherwise("missing")
    order = F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("c"), F.col("l_extendedprice").alias("d"))
    bullet = F.struct(F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("bullet_id"), F.lit("text").alias("text"), F.array().cast("array<string>").alias("claim_keys"))
    return l.select(F.col("l_orderkey").alias("posting_id"), (F.col("l_suppkey") % 3).alias("variant_id"), F.col("l_linenumber").alias("requirement_id"), F.when(F.col("l_linestatus") == "O", "hard").otherwise("nice").alias("kind"), F.col("l_shipdate").cast("string").alias("text"), order.alias("ordinal"), level.alias("level"), F.lit(None).cast("string").alias("note"), bullet.alias("evidence"))


_GAPS = "SELECT l_orderkey AS posting_id, l_suppkey % 3 AS variant_id, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_linestatus = 'O' AS hard, l_returnflag = 'N' AS missing FROM lineitem WHERE l_returnflag <> 'R'"


@query("gap_lists", with_(g=_GAPS) + "SELECT posting_id, variant_id, string_agg(CAST(l_linenumber AS STRING) || CASE WHEN missing THEN 'm' ELSE 'p' END, ',' ORDER BY hard DESC, missing DESC, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS gaps, count(*) FILTER (hard AND missing) AS blocking FROM g GROUP BY 1, 2")
def gap_lists(spark, sf_dir):
    rows = scoring.gaps(_level_rows(spark, sf_dir))
    shown = F.array_join(F.transform("gaps", lambda g: F.concat(g["requirement_id"].cast("string"), F.left(g["level"], F.lit(1)))), ",")
    return rows.select("posting_id", "variant_id", shown.alias("gaps"), F.size(scoring.blocking(F.col("gaps"))).cast("long").alias("blocking"))


@query("top_scores", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def top_scores(spark, sf_dir):
    return scoring.top(table(spark, sf_dir, "orders"), 40, F.desc("o_totalprice"), "o_orderkey").select(F.col("o_orderkey").alias("id"))


_PRICED = "SELECT l_orderkey, l_partkey % 1000 AS fresh, l_suppkey % 100 AS cached, CAST(l_quantity AS INT) AS written, l_linenumber * 37 AS output FROM lineitem"


@query("model_call_costs", with_(x=_PRICED) + "SELECT l_orderkey AS posting_id, CAST(sum(round((fresh * 3.0 + cached * 0.3 + written * 3.75 + output * 15.0) * 88.5 / 1000000 + 1e-12, 2)) AS DECIMAL(18,2)) AS inr FROM x GROUP BY 1")
def model_call_costs(spark, sf_dir):
    from decimal import Decimal

    cost = scores.call_cost(F.col("fresh"), F.col("cached"), F.col("written"), F.col("output"), Decimal("3.0"), Decimal("15.0"), Decimal("88.5"))
    return run(spark, sf_dir, _PRICED).groupBy(F.col("l_orderkey").alias("posting_id")).agg(F.sum(cost).cast("decimal(18,2)").alias("inr"))


@query("slice_candidates", with_(postings=standins.POSTINGS, w="SELECT *, len(string_split(trim(description_text, ' '), ' ')) AS words FROM postings") + """SELECT company_id, id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen_day DESC, id) AS r FROM w
WHERE words BETWEEN 60 AND 400 AND (title LIKE '%Engineer%' OR title LIKE '%Analyst%') AND closed_at IS NULL AND NOT filtered_out AND length(description_text) > 200) WHERE r = 1""")
def slice_candidates(spark, sf_dir):
    postings = run(spark, sf_dir, standins.POSTINGS).withColumn("first_seen_at", F.col("first_seen_day"))
    return diagnostics.slice_candidates(postings, ("engineer", "analyst"), 60, 400).select("company_id", "id")


# ---------------------------------------------------------------- seeds


@query("alias_conflicts", "SELECT lower(p_name) AS alias, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS tokens FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def alias_conflicts(spark, sf_dir):
    surfaces = table(spark, sf_dir, "part").select(F.col("p_brand").alias("token"), F.upper("p_name").alias("surface"))
    return duplicate_aliases(surfaces).select("alias", F.array_join("tokens", ",").alias("tokens"))


@query("absent_members", "SELECT DISTINCT p_brand AS token, p_type AS member FROM part WHERE p_type NOT IN ('LARGE', 'SMALL')")
def absent_members(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    composites = p.groupBy(F.col("p_brand").alias("token")).agg(F.collect_set("p_type").alias("members"))
    plain = p.filter("p_type in ('LARGE', 'SMALL')").select(F.col("p_type").alias("token")).distinct().withColumn("members", F.array().cast("array<string>"))
    return unresolved_composites(composites.unionByName(plain))


@query("seeded_files", """SELECT 'company' AS kind, lower(n_name) AS key, CAST(n_nationkey % 3 AS STRING) AS detail FROM nation UNION ALL SELECT 'source', lower(n_name), 'board' || n_nationkey FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'claim', lower(r_name), 'yes' FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'tag', 'b' || r_regionkey, 'sql' FROM region UNION ALL SELECT 'case', lower(r_name), 'Text of ' || r_name FROM region UNION ALL SELECT 'variant', lower(r_name), 'sql' FROM region""")
def seeded_files(spark, sf_dir):
    """Seed files of companies, claims, tags, cases and variants, written to the shared folder and loaded; each is a file of settings."""
    folder = f"{shared_folder(spark)}/seeds-{uuid.uuid4().hex}"
    out = files.Folder(spark, folder)
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    site = F.array(F.struct(F.lit("lever").alias("adapter"), F.create_map(F.lit("site"), F.concat(F.lit("board"), F.col("n_nationkey").cast("string"))).alias("config")))
    company = F.struct(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).cast("string").alias("tier"), F.when(F.col("n_nationkey") % 3 > 0, site).alias("sources"))
    claim = F.struct(F.lower("r_name").alias("key"), F.concat(F.lit("Sold in "), "r_name").alias("statement"), F.when(F.col("r_regionkey") % 2 == 0, "yes").otherwise("no").alias("verdict"))
    tag = F.struct(F.concat(F.lit("b"), F.col("r_regionkey").cast("string")), F.struct(F.array(F.lit("sql")).alias("skills"), F.array().cast("array<string>").alias("claims"), F.col("r_name").alias("text")))
    out.create("companies.json", n.agg(F.to_json(F.struct(F.collect_list(company).alias("companies")))).first()[0])
    out.create("claims.json", r.agg(F.to_json(F.struct(F.collect_list(claim).alias("claims")))).first()[0])
    out.create("tags.json", r.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(tag)).alias("bullets")))).first()[0])
    for name in (row[0] for row in r.select("r_name").collect()):
        out.create(f"cases/{name}.yaml", f"id: '{name.lower()}'\nslice: terse\njd_text_file: {name}.txt\n")
        out.create(f"cases/{name}.txt", f"Text of {name}")
        out.create(f"variants/{name.lower()}.json", '{"experience": [], "projects": [], "skills": [{"label": "Tools", "items": ["sql"]}]}')
    loaded, sources = seeds.load_companies(spark, f"{folder}/companies.json")
    sources = sources.join(loaded.select(F.col("id").alias("company_id"), "slug"), "company_id")
    row = lambda df, kind, key, detail: df.select(F.lit(kind).alias("kind"), key.alias("key"), detail.cast("string").alias("detail"))
    parts = [
        row(loaded, "company", F.col("slug"), F.col("tier")),
        row(sources, "source", F.col("slug"), F.col("config")["site"]),
        row(seeds.load_claims(spark, f"{folder}/claims.json"), "claim", F.col("key"), F.col("verdict")),
        row(seeds.load_tags(spark, f"{folder}/tags.json"), "tag", F.col("bullet_id"), F.col("skills")[0]),
        row(seeds.load_cases(spark, f"{folder}/cases"), "case", F.col("id"), F.col("text")),
        row(seeds.load_variants(spark, f"{folder}/variants"), "variant", F.col("key"), F.col("content.skills")[0]["items"][0]),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("rows_at_fixed_width", """WITH w AS (SELECT greatest(max(length(CAST(p_partkey AS VARCHAR))), 9) AS a, greatest(max(length(p_name)), 6) AS b FROM part)
SELECT p_partkey AS id, rtrim(rpad(CAST(p_partkey AS VARCHAR), CAST(a AS INT), ' ') || '  ' || rpad(p_name, CAST(b AS INT), ' ') || '  ' || p_brand) AS line FROM part, w""")
def rows_at_fixed_width(spark, sf_dir):
    return sinks.as_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")).select(F.col("p_partkey").alias("id"), "line")


@query("rows_as_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def rows_as_json(spark, sf_dir):
    return sinks.as_json(table(spark, sf_dir, "nation"))
