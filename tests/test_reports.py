"""Reports that have no stand-in among the benchmark tables."""

import datetime as dt
import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest, requirements
from millrace.plans import diagnostics, funnel, quantiles, reports

D = dt.datetime


def as_of():
    return F.lit("2024-02-10 00:00:00").cast("timestamp")


def test_claims(spark):
    claims = spark.createDataFrame([(1, "a", D(2024, 2, 1), D(2024, 1, 1), None), (2, "b", D(2024, 3, 1), D(2024, 1, 1), None), (3, "c", None, D(2023, 1, 1), None), (4, "d", None, D(2024, 1, 1), None), (5, "e", D(2024, 1, 1), D(2023, 1, 1), D(2024, 1, 2))], "id int, key string, expires_at timestamp, verified_at timestamp, deleted_at timestamp")
    due = reports.claims_due(claims, as_of()).collect()
    assert [(r["key"], r["expired"]) for r in due] == [("a", True), ("b", False), ("c", None)]
    usage = spark.createDataFrame([(1, 10, "x"), (2, 10, "y")], "claim_id int, artifact_id int, location string")
    artifacts = spark.createDataFrame([(10, "resume", D(2024, 2, 5), 7, False, 100)], "id int, kind string, generated_at timestamp, posting_id int, validated boolean, application_id int")
    apps = spark.createDataFrame([(100, 10, 10, "offer"), (101, None, 11, "rejected")], "id int, resume_artifact_id int, cover_letter_artifact_id int, status string")
    assert {(r["key"], r["was_stale"]) for r in reports.claims_of_artifact(usage, claims, artifacts).collect()} == {("a", True), ("b", False)}
    assert {(r["key"], r["application_id"], r["expired_now"]) for r in reports.claims_of_application(apps, usage, claims, artifacts, as_of()).collect()} == {("a", 100, True), ("b", 100, False)}
    assert {r["application_status"] for r in reports.claim_uses(usage, artifacts, apps).collect()} == {"offer"}
    assert reports.invalid_artifacts(artifacts).first()["offending"] == "10 (resume)"


def test_runs_with_costs(spark):
    stats = lambda **k: json.dumps(k)
    rows = [
        ("r1", "discovery", D(2024, 2, 9), D(2024, 2, 9, 0, 1), "completed", stats(llm_cost_inr="10.005", extracted=4, extract_cache_hits=1, llm_calls=3), "[{},{}]"),
        ("r2", "discovery", D(2024, 2, 9, 5), D(2024, 2, 9, 5, 2), "failed", stats(llm_cost_inr="1.10", extracted=0, llm_calls=2), "[]"),
        ("r3", "mail", D(2024, 1, 1), None, "running", stats(), None),
    ]
    runs = spark.createDataFrame(rows, "id string, run_type string, started_at timestamp, finished_at timestamp, status string, stats string, source_results string")
    assert [r["calls"] for r in reports.daily_model_totals(runs, as_of()).collect()] == [5]
    costs = {r["extracted"]: r["inr_per_posting"] for r in reports.cost_per_posting(runs, as_of()).collect()}
    assert costs[0] is None and abs(float(costs[4]) - 2.5) < 0.01
    assert [float(r["hit_pct"]) for r in reports.cache_hits(runs, as_of()).collect() if r["hit_pct"] is not None] == [25.0]
    assert {(r["seconds"], r["sources_attempted"]) for r in reports.duration_trend(runs, as_of()).collect()} == {(60, 2), (120, 0)}
    assert [r["id"] for r in reports.newest_runs(runs, 2).collect()] == ["r2", "r1"]
    late = ingest.stranded_runs(runs, as_of(), 3600)
    assert {r["id"]: r["status"] for r in late.collect()} == {"r1": "completed", "r2": "failed", "r3": "failed"}
    found = spark.createDataFrame([("r", json.dumps([{"source_id": 7, "status": "ok"}, {"source_id": 7, "status": "x"}]))], "id string, source_results string")
    assert reports.result_of(found, 7).first()["result"]["status"] == "ok" and reports.result_of(found, 8).first()["result"] is None


def test_run_log_row(spark):
    results = spark.createDataFrame([(1, "ok", 3, {"dup": 1}), (2, "timeout", 0, {"dup": 2, "x": 1})], "source_id int, status string, fetched int, skipped map<string,int>")
    stats = reports.folded_results(results)
    row = reports.run_log_row(stats, "r", as_of(), as_of()).first()
    assert json.loads(row["stats"])["sources_failed"] == 1
    assert {(r["reason"], r["n"]) for r in reports.skipped_by_reason(results).collect()} == {("dup", 3), ("x", 1)}
    assert reports.failure_summary(results).first()["summary"] == "1 source(s) failed: 1 timeout"
    assert reports.failure_summary(results.filter("status = 'ok'")).count() == 0
    assert reports.run_status(results.limit(0)).first()["status"] == "completed"


def test_companies_and_sources(spark):
    companies = spark.createDataFrame([(1, "B", "b", "dream", "tracking", None), (2, "A", "a", "volume", "paused", None), (3, "U", "unmatched", "volume", "tracking", None), (4, "X", "x", "volume", "tracking", D(2024, 1, 1))], "id int, name string, slug string, tier string, status string, deleted_at timestamp")
    assert [r["name"] for r in reports.listed_companies(companies).collect()] == ["A", "B", "U"]
    assert [r["name"] for r in reports.listed_companies(companies, tier="dream").collect()] == ["B"]
    assert reports.company_of(companies, "2").first()["name"] == "A" and reports.company_of(companies, "b").first()["id"] == 1
    sources = spark.createDataFrame([(10, 1, "mail_alert", True, "ok", 0), (11, 2, "lever", True, None, 2)], "id int, company_id int, adapter string, enabled boolean, last_status string, consecutive_failures int")
    assert [r["slug"] for r in reports.companies_by_source(companies, sources).collect()] == ["unmatched", "x", "a", "b"]
    assert [r["id"] for r in reports.filtered_sources(sources, failing=True).collect()] == [11] and reports.filtered_sources(sources, adapter="lever", enabled=False).count() == 0
    postings = spark.createDataFrame([(1, 10, 3, None), (2, 10, 1, None), (3, 10, 1, D(2024, 1, 1))], "id int, source_id int, company_id int, closed_at timestamp")
    assert [(r["open_leads"], r["across_companies"]) for r in reports.alert_sources(sources, postings).collect()] == [(2, 2)]
    assert [r["n"] for r in reports.unmatched_leads(postings, companies).collect()] == [1]
    assert reports.with_company_status(companies, 1, "paused").filter("id = 1").first()["status"] == "paused"
    assert tuple(reports.counts_in_one_row({"c": companies, "none": companies.limit(0)}).first()) == (4, 0)
    config = spark.sql("SELECT 1 AS id, 1 AS company_id, 'lever' AS adapter, map('site', 'x', 'a', 'y') AS config")
    assert reports.find_source(config, 1, "lever", F.create_map(F.lit("a"), F.lit("y"), F.lit("site"), F.lit("x"))).count() == 1
    assert reports.inserted_if_absent(companies, companies.filter("id = 1").withColumn("slug", F.lit("new")), ["slug"]).count() == 5
    reasons = spark.createDataFrame([("title_keyword",), ("location",)], "r string").select(reports.reason_alias(F.col("r"))).collect()
    assert [r[0] for r in reasons] == ["title_denylist", "location"]


def test_requirement_reports(spark):
    rows = spark.createDataFrame([("p", "hard", "a", None, "v1"), ("p", "hard", "a", None, "v1"), ("q", "nice", "b", "python", "v1"), ("q", "hard", "c", "python", "v2")], "posting_id string, kind string, text string, normalised_skill string, prompt_version string")
    assert [tuple(r) for r in requirements.unresolved_texts(rows).collect()] == [("a", 2)]
    assert {tuple(r) for r in diagnostics.postings_by_version(rows).collect()} == {("v1", 2), ("v2", 1)}
    assert [tuple(r) for r in diagnostics.top_skills(rows, 1).collect()] == [("python", 2)]
    assert {r["kind"]: r["resolved"] for r in diagnostics.resolution_rates(rows).collect()} == {"hard": 1, "nice": 1}
    answers = rows.select("posting_id").union(spark.createDataFrame([("empty",)], "posting_id string"))
    assert requirements.extraction_summary(answers, rows).first().asDict() == {"postings": 3, "requirements": 4, "resolved": 2, "unresolved": 2, "empty_postings": 1}
    new = rows.filter("posting_id = 'p'").limit(1)
    assert requirements.replaced(rows, new, ["posting_id"]).count() == 3


def test_slices_and_follow_ups(spark):
    postings = spark.createDataFrame([(1, 1, "Backend Engineer", "word " * 100, 1), (2, 1, "Backend Dev", "word " * 80, 2), (3, 2, "Nurse", "word " * 90, 1)], "id int, company_id int, title string, description_text string, first_seen_at int").withColumn("closed_at", F.lit(None).cast("timestamp")).withColumn("filtered_out", F.lit(False))
    assert {r["id"] for r in diagnostics.slice_candidates(postings, hints=("backend",)).collect()} == {2}
    assert {r["id"] for r in diagnostics.slice_candidates(postings, fewest=85).collect()} == {1, 3}
    due = spark.createDataFrame([(1, "volume", 50), (2, "dream", 10), (3, "dream", 20), (4, "strong", 90)], "application_id int, tier string, quiet_days int")
    assert [r["application_id"] for r in funnel.todays_follow_ups(due).collect()] == [3, 2, 4]


def test_error_codes(spark):
    rows = spark.createDataFrame([("http.500",), ("timeout",), ("policy.host",), ("odd",), (None,)], "c string")
    assert [r[0] for r in rows.select(ingest.status_of_error(F.col("c"))).collect()] == ["http_error", "timeout", "denied_by_policy", "error", "ok"]


@pytest.mark.parametrize("q", [0.5, 0.0, 1.0, 0.9])
def test_exact_quantiles(spark, q):
    """As numpy has them, with ties, both ends of the longs and a group without a name."""
    rnd = random.Random(8)
    groups = {"a": [rnd.randrange(-(10**12), 10**12) for _ in range(301)], "b": [5] * 40 + [7] * 41, None: [3, 4], "c": [-(2**52), 2**52, 0], "d": [9]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v long")
    got = {r["g"]: (r["quantile"], r["n"]) for r in quantiles.exact_quantile(rows, ["g"], F.col("v"), q).collect()}
    assert got == {g: (pytest.approx(float(np.quantile(vs, q)), rel=1e-12), len(vs)) for g, vs in groups.items()}


def test_replaced_rows_pass_unsorted(spark):
    stored, new = spark.range(40).selectExpr("id % 8 AS posting_id", "id"), spark.createDataFrame([(1, 100), (1, 101), (9, 102)], "posting_id long, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = requirements.replaced(stored, new, ["posting_id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = sorted((r["posting_id"], r["id"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert kept == sorted([(i % 8, i) for i in range(40) if i % 8 != 1] + [(1, 100), (1, 101), (9, 102)])
