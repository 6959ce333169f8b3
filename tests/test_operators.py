"""Operators on small invented rows."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation, ingest, matching, requirements, screen, scoring, variants, vocabulary
from millrace.plans import reports

POSTING = "id string, company_id int, title string, description_text string, location_city string, location_country string, is_remote boolean, seniority_guess string, closed_at timestamp, filtered_out boolean, filter_reason string, needs_description boolean"
LONG = "We build things. " * 40


def posting(id="p", company=1, title="Engineer", text=LONG, city=None, country=None, remote=False, seniority=None, closed=None, out=False, reason=None, stub=None):
    return (id, company, title, text, city, country, remote, seniority, closed, out, reason, stub)


def judge(spark, *rows, status="tracking", places=()):
    companies = spark.createDataFrame([(1, "acme", status, list(places))], "id int, slug string, status string, location_filter array<string>")
    return screen.verdicts(screen.with_company(spark.createDataFrame(list(rows), POSTING), companies))


NOW = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("given", "reason"), [
    ({}, None), ({"closed": NOW}, "closed"), ({"text": "short"}, "description_too_short"), ({"stub": True}, "no_description"), ({"seniority": "Staff"}, "seniority:staff"),
    ({"country": "DE"}, "location"), ({"country": "in"}, None), ({"remote": True, "country": "DE"}, None), ({"title": "Account Executive, Sales"}, "title_keyword:account executive"),
    ({"title": "Presales"}, None), ({"text": LONG + "quota and salesforce"}, "role_domain:quota+salesforce"), ({"text": LONG + "quota"}, None),
    ({"text": LONG + "6+ years of experience"}, "experience:6y"), ({"text": LONG + "5+ years of experience"}, None),
    ({"out": True, "reason": "superseded_by:x", "closed": NOW}, "superseded"),
    ({"text": LONG + "quota gong twitch icp bant devrel"}, "role_domain:bant+devrel+gong+icp+2 more"),
])
def test_chain(spark, given, reason):
    assert judge(spark, posting(**given)).first()["reason"] == reason


def test_vetoes_and_company_filters(spark):
    assert judge(spark, posting(city="Pune", country="IN"), places=["!Pune", "IN"]).first()["reason"] == "location_excluded:pune"
    assert judge(spark, posting(country="DE"), places=["DE"]).first()["reason"] is None
    assert judge(spark, posting(), status="blacklisted").first()["reason"] == "company_blacklisted"


def test_screen_is_idempotent(spark):
    rows = [posting("a", country="DE"), posting("b", out=True, reason="location"), posting("c", out=True, reason="superseded_by:a"), posting("d")]
    frame = spark.createDataFrame(rows, POSTING)
    delta = screen.screen_delta(judge(spark, *rows))
    assert sorted(map(tuple, delta.collect())) == [("a", True, "location"), ("b", False, None)]
    again = screen.apply_delta(frame, delta).collect()
    assert screen.screen_delta(judge(spark, *[tuple(r) for r in again])).count() == 0


CANDIDATE = "id string, company_id int, title string, location_city string, adapter string, source_id int, content_hash string, first_seen_at int, filtered_out boolean, filter_reason string"


def collapse(spark, rows):
    return {r["id"]: (r["action"], r["winner_id"]) for r in ingest.collapse_plan(spark.createDataFrame(rows, CANDIDATE)).collect()}


def test_collapse(spark):
    rows = [
        ("mail", 1, "SDE II", "Pune", "mail_alert", 9, "h1", 0, False, None), ("board", 1, "Software Engineer 2 (x)", "Pune", "greenhouse", 1, "h2", 5, False, None),
        ("same", 1, "SDE II", "Pune", "greenhouse", 1, "h2", 6, False, None), ("other", 1, "SDE II", "Pune", "greenhouse", 1, "h3", 7, True, "superseded_by:gone"),
        ("alone", 1, "Analyst", None, "lever", 2, "h4", 1, False, None), ("twin", 1, "Analyst", None, "ashby", 3, "h5", 2, True, "superseded_by:old"),
    ]
    want = {"mail": ("supersede", "board"), "same": ("supersede", "board"), "other": ("restore", None), "alone": ("supersede", "twin"), "twin": ("restore", None)}
    assert collapse(spark, rows) == want
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert collapse(spark, rows) == want
    frame = spark.createDataFrame(rows, CANDIDATE)
    after = screen.apply_delta(frame, ingest.collapse_delta(ingest.collapse_plan(frame)))
    assert ingest.collapse_plan(after).count() == 0


def test_persist_and_close(spark):
    fetched = spark.createDataFrame([("a", 1, 1, "t", "text a", 0), ("b", 1, 1, "t", "text b", 1), ("b", 1, 1, "t", "second", 2), ("c", 1, 1, "t", "text c", 3)], "external_id string, source_id int, company_id int, title string, description_text string, ordinal int")
    first = ingest.classified(fetched, spark.createDataFrame([], "source_id int, external_id string, id string, content_hash string, company_id int"))
    assert {(r["external_id"], r["change"]) for r in first.collect()} == {("a", "new"), ("b", "new"), ("c", "new")}
    stored = first.select("id", "source_id", "external_id", "company_id", "title", "description_text", "content_hash").withColumn("missed_runs", F.lit(1)).withColumn("first_seen_at", F.lit("2024-01-01").cast("timestamp")).withColumn("last_seen_at", F.col("first_seen_at")).withColumn("closed_at", F.lit(None).cast("timestamp")).withColumn("filtered_out", F.lit(False))
    second = spark.createDataFrame([("a", 1, 1, "t", "text  a", 0), ("b", 1, 2, "new", "text b", 1), ("d", 1, 1, "t", "text d", 2)], fetched.schema)
    plan = ingest.classified(second, stored)
    assert {(r["external_id"], r["change"]) for r in plan.collect()} == {("a", "unchanged"), ("b", "updated"), ("d", "new")}
    now = F.lit("2024-02-01").cast("timestamp")
    table = {r["external_id"]: r for r in ingest.upserted(stored, plan, now).collect()}
    assert set(table) == {"a", "b", "c", "d"} and table["b"]["title"] == "new" and table["a"]["missed_runs"] == 0 and table["c"]["missed_runs"] == 1
    assert table["a"]["first_seen_at"] < table["a"]["last_seen_at"] == table["d"]["first_seen_at"]
    runs = spark.createDataFrame([(1, "ok", dt.datetime(2024, 2, 1))], "source_id int, status string, seen_at timestamp")
    delta = ingest.close_delta(ingest.missed(ingest.upserted(stored, plan, now), runs)).collect()
    assert [(r["missed_runs"], r["closed_at"] is not None) for r in delta] == [(2, True)]
    frozen = runs.withColumn("status", F.lit("timeout"))
    assert ingest.missed(stored, frozen).count() == 0


def test_source_health(spark):
    sources = spark.createDataFrame([(1, 4, True, "ok", None, None), (2, 3, True, "error", "x", None), (3, 1, True, "ok", None, None)], "id int, consecutive_failures int, enabled boolean, last_status string, last_error string, last_run_at timestamp")
    outcomes = spark.createDataFrame([(1, "timeout", "late", NOW), (2, "ok", None, NOW), (3, "rate_limited", "slow", NOW)], "source_id int, status string, error string, run_at timestamp")
    got = {r["id"]: r for r in ingest.source_health(sources, outcomes).collect()}
    assert (got[1]["consecutive_failures"], got[1]["enabled"]) == (5, False) and (got[2]["consecutive_failures"], got[2]["last_error"]) == (0, None) and got[3]["consecutive_failures"] == 1


def test_raw_flags(spark):
    row = spark.sql("SELECT map('a', '1', 'b', '2') AS raw").select(ingest.raw_with_flags(F.col("raw"), F.create_map(F.lit("b"), F.lit("3")), F.lit(True), F.lit(99)).alias("m")).first()
    assert row["m"] == {"a": "1", "b": "3", "description_truncated": "true", "description_original_chars": "99"}


def test_similar_names_equal_the_cross_product(spark):
    rnd = random.Random(2)
    words = ["acme", "corp", "corporation", "labs", "data", "dato", "systems", "system"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 3))) for _ in range(40)})
    a = spark.createDataFrame([(n,) for n in names], "name string")
    for t in (0.3, 0.45, 0.8):
        got = {(r["a_name"], r["b_name"]) for r in matching.similar_names(a, a, t).collect()}
        every = a.selectExpr("name AS x").crossJoin(a.selectExpr("name AS y")).select("x", "y", matching.similarity(F.col("x"), F.col("y")).alias("s")).filter(F.col("s") >= t)
        assert got == {(r["x"], r["y"]) for r in every.collect()}
    assert a.limit(1).select(matching.similarity(F.lit("Acme Corp"), F.lit("Acme Corporation"))).first()[0] == 0.5


def test_best_company_compares_no_settled_names(spark, monkeypatch):
    """Names with a company's trigrams take its smallest id without a comparison, the others the most similar company's."""
    rows = [(7, "Acme Corp"), (3, "corp acme"), (5, "Acme Corporation"), (1, "###"), (2, "Data Labs")]
    companies = spark.createDataFrame([(i, n, n.lower(), None) for i, n in rows], "id long, name string, slug string, deleted_at timestamp")
    names = spark.createDataFrame([("ACME corp",), ("acme corporations",), ("data lab",), ("###",), ("zebra",), (None,)], "name string")
    compared, plain = [], matching.similar_names
    monkeypatch.setattr(matching, "similar_names", lambda left, *rest: compared.extend(r["name"] for r in left.collect()) or plain(left, *rest))
    got = {r["name"]: (r["company_id"], round(r["similarity"], 6)) for r in matching.best_company(names, companies).collect()}
    assert sorted(compared) == ["###", "acme corporations", "data lab", "zebra"]
    assert got == {"ACME corp": (3, 1.0), "acme corporations": (5, 0.842105), "data lab": (2, 0.727273)}


def test_collapse_of_changed_roles(spark, tmp_path):
    """Winners of changed roles equal those of a collapse of everything; other roles are not touched."""
    rnd = random.Random(12)

    def posting(i):
        return (str(i), rnd.choice([1, 2]), rnd.choice(["Dev", "dev (Remote)", "Ops"]), rnd.choice(["Pune", None]), rnd.choice(["ashby", "lever", "mail_alert"]), rnd.choice([1, 2, 3]), rnd.choice(["h1", "h2"]), rnd.randint(1, 5), False, None)

    before = {i: posting(i) for i in range(60)}
    after = {i: (posting(i) if i % 7 == 0 else row) for i, row in before.items() if i % 11} | {100 + i: posting(100 + i) for i in range(5)}
    frame = lambda rows: spark.createDataFrame(list(rows), CANDIDATE)
    table = ingest.winners_table(spark, f"{tmp_path}/w", frame(before.values()), 4)
    moved = [row for i, row in before.items() if after.get(i) != row] + [row for i, row in after.items() if before.get(i) != row]
    plan = ingest.collapse_changed(table, frame(after.values()), frame(moved))
    whole = ingest.winners(ingest.by_role(frame(after.values())))
    assert sorted(map(repr, table.read().filter("w is not null").collect())) == sorted(map(repr, whole.select(*table.read().columns).collect()))
    every = {r["id"]: (r["action"], r["winner_id"]) for r in ingest.collapse_plan(frame(after.values())).collect()}
    part = {r["id"]: (r["action"], r["winner_id"]) for r in plan.collect()}
    assert part and part.items() <= every.items()


def test_leads(spark):
    companies = spark.createDataFrame([(1, "Acme", "acme", None), (2, "Unmatched", "unmatched", None)], "id long, name string, slug string, deleted_at timestamp")
    leads = spark.createDataFrame([("x", "ACME Corp. Ltd"), ("y", "Zebra GmbH"), ("z", "  ")], "external_id string, company_name string")
    got = {r["external_id"]: r["company_id"] for r in matching.resolved_leads(leads, companies).collect()}
    assert got == {"x": 1, "y": 2, "z": 2}
    assert matching.with_reserved_company(companies).count() == 2 and matching.with_reserved_company(companies.filter("id = 1")).count() == 2


def skills():
    S = vocabulary.Skill
    return vocabulary.Vocabulary("v.2", (S("python", "Python", "language", ("py3",)), S("go", "Go", "language"), S("cpp", "C++", "language"), S("aws", "AWS", "cloud"), S("gcp", "GCP", "cloud", ("google cloud",)), S("agile", "Agile", "practice"), S("stack", "Stack", "other", (), ("python", "aws"))), {"cloud": 0.6})


def test_vocabulary(spark):
    v = skills()
    sentences = {
        "We use C++, AWS or Google Cloud, and Agile": (["aws", "cpp", "gcp"], None), "AWS or GCP": (["aws", "gcp"], ["aws", "gcp"]), "one of: AWS, GCP": (["aws", "gcp"], ["aws", "gcp"]),
        "both AWS or GCP": (["aws", "gcp"], None), "AWS and GCP": (["aws", "gcp"], None), "Python or AWS": (["aws", "python"], None), "or: AWS, GCP": (["aws", "gcp"], None),
        "two or more of AWS/GCP": (["aws", "gcp"], None), "C++/Python": (["cpp", "python"], ["cpp", "python"]), "xC++ C++y AWSome google  cloud": ([], None), "": ([], None), None: ([], None), "AWS": (["aws"], None),
    }
    told = spark.createDataFrame([(x,) for x in sentences], "x string").select("x", vocabulary.tokens_within(F.col("x"), v), vocabulary.alternatives_within(F.col("x"), v)).collect()
    assert {x: (found, either) for x, found, either in told} == sentences
    rows = spark.createDataFrame([("PYTHON!", None), ("unknown", "C++"), ("Google  Cloud", "go"), (None, None)], "text string, hint string")
    assert [r["token"] for r in vocabulary.resolved_with_hint(rows, v, "text", "hint").collect()] == ["python", "cpp", "gcp", None]
    for bad in ((vocabulary.Skill("a", "X"), vocabulary.Skill("b", "x")), (vocabulary.Skill("a", "A", members=("zz",)),), (vocabulary.Skill("a", "A"), vocabulary.Skill("a", "B"))):
        with pytest.raises(vocabulary.VocabularyError):
            vocabulary.Vocabulary("v", bad)


def test_requirements(spark):
    v = skills()
    answers = spark.createDataFrame([("p", ([("hard", "Python", None, 0.755, 9), ("nice", " python ", None, 0.5, 1), ("tool", "thing", "AWS", 1.0, 2)], "mid", None, ""))], f"posting_id string, answer {requirements.EXTRACTION.simpleString()}")
    rows = requirements.prepared(answers, v)
    got = [(r["ordinal"], r["kind"], r["normalised_skill"], r["weight"]) for r in rows.orderBy("ordinal").collect()]
    assert got == [(0, "hard", "python", Decimal("0.76")), (1, "tool", "aws", Decimal("1.00"))]
    assert answers.select(requirements.valid_extraction(F.col("answer"))).first()[0]
    stored = spark.createDataFrame([("Python", None, None, "x+v.1"), ("AWS thing", None, "aws", "x+v.1"), ("uses gcp daily", None, None, "x+v.1"), ("Go", None, "go", "x+v.2"), ("zz", "gcp", "aws", "x+v.1")], "text string, normalised_skill_hint string, normalised_skill string, prompt_version string")
    out = requirements.reresolved(stored, v, containment=True)
    assert {r["text"]: r["outcome"] for r in out.collect()} == {"Python": "gained", "AWS thing": "rebound", "uses gcp daily": "gained", "Go": "same", "zz": "changed"}
    plain = requirements.reresolution_counts(requirements.reresolved(stored, v)).first().asDict()
    assert plain == {"examined": 5, "gained": 1, "lost": 0, "changed": 1, "unrecoverable": 1, "by_containment": 0, "rewritten": 3}
    noise = spark.createDataFrame([("hard", "Strong communication skills", None), ("hard", "x", "python"), ("nice", "fast-paced", None)], "kind string, text string, normalised_skill string")
    assert [(r["kind"], r["phrase"]) for r in requirements.boilerplate_delta(noise).collect()] == [("condition", "communication skill")]


CONTENT = {"experience": [{"blocks": [{"bullets": [{"id": "b1", "text": "Cut cost 40%", "skills": ["aws"], "claim_keys": []}, {"id": "b2", "text": "Led Python work", "skills": ["python"], "claim_keys": []}]}]}], "projects": [{"bullets": [{"id": "b3", "text": "Saved 10 hours", "skills": ["aws"], "claim_keys": ["k"]}, {"id": "b4", "text": "Did it", "skills": [], "claim_keys": []}]}], "skills": [{"label": "L", "items": ["Python 3.11 / C++", "Clouds (AWS, GCP)", "Knitting"]}]}


def one_variant(spark):
    return spark.createDataFrame([(1, CONTENT)], f"id int, content {variants.CONTENT.simpleString()}")


def test_variants(spark):
    v, frame = skills(), one_variant(spark)
    assert [r["bullet_id"] for r in variants.bullets(frame).orderBy("position").collect()] == ["b1", "b2", "b3", "b4"]
    sets = variants.skill_sets(frame, v).first()
    assert sets["skill_set"] == ["aws", "cpp", "gcp", "python"] and sets["unproven"] == ["cpp", "gcp"]
    assert [r["item"] for r in variants.unresolved_items(frame, v).collect()] == ["Knitting"]
    assert [r["bullet_id"] for r in variants.untagged_bullets(frame).collect()] == ["b4"]
    approved = spark.createDataFrame([("other",)], "key string")
    assert [(r["problem"], r["value"]) for r in variants.tag_problems(frame, v.skill_table(spark), approved).collect()] == [("claim not approved", "k")]
    tags = spark.createDataFrame([("b4", ["go"], ["c"])], "bullet_id string, skills array<string>, claims array<string>")
    tagged = {r["bullet_id"]: (r["skills"], r["claim_keys"]) for r in variants.bullets(variants.with_tags(frame, tags)).collect()}
    assert tagged["b4"] == (["go"], ["c"]) and tagged["b1"] == (["aws"], [])
    assert list(variants.split_item("A (b; c (d)) / E")) == ["A (b; c (d)) / E", "A", "E", "b", "c (d)"]


def test_levels_together_are_not_shuffled_again(spark):
    """Rows for each variant stay where their posting's requirements were brought together."""
    v = skills()
    rows = spark.createDataFrame([(1, 1, "hard", "t", "aws", 1.0, 1), (1, 2, "nice", "u", None, 0.5, 2)], "posting_id long, requirement_id long, kind string, text string, normalised_skill string, weight double, ordinal long")
    sets = spark.createDataFrame([(1, ["aws"]), (2, ["go"])], "variant_id int, skill_set array<string>")
    shows = spark.createDataFrame([(1, 1, "b", "Runs AWS", ["c"], ["aws"])], "variant_id int, position int, bullet_id string, text string, claim_keys array<string>, skills array<string>")
    covered = {}
    for together in (False, True):
        covered[together] = scoring.coverage(scoring.levels(rows, sets, shows, v.skill_table(spark), together=together))
        plan = covered[together]._jdf.queryExecution().executedPlan().toString()
        assert bool(re.search(r"hashpartitioning\(posting_id#\d+L, variant_id#\d+", plan)) is not together
    assert sorted(map(repr, covered[True].collect())) == sorted(map(repr, covered[False].collect()))


def test_levels(spark):
    v, frame = skills(), one_variant(spark)
    sets = variants.skill_sets(frame, v).select("variant_id", "skill_set")
    rows = spark.createDataFrame([("p", i, "hard", t, t, Decimal("1.00"), i) for i, t in enumerate(["python", "aws", "cpp", "stack", "go", None, "agile"])], "posting_id string, requirement_id int, kind string, text string, normalised_skill string, weight decimal(3,2), ordinal int")
    got = {r["text"]: r for r in scoring.levels(rows, sets, variants.bullets(frame), v.skill_table(spark)).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"python": "met", "aws": "met", "cpp": "partial", "stack": "met", "go": "missing", None: "missing", "agile": "missing"}
    assert got["aws"]["evidence"]["bullet_id"] == "b3" and got["cpp"]["note"].startswith("Listed as a skill")
    few = scoring.levels(rows, spark.createDataFrame([(2, ["aws"])], "variant_id int, skill_set array<string>"), variants.bullets(frame), v.skill_table(spark))
    got = {r["text"]: (r["level"], r["note"]) for r in few.collect()}
    assert got["stack"] == ("partial", "Covers aws; no evidence for python.") and got["aws"][0] == "partial"


def test_coverage_and_rank(spark):
    rows = [("p", 1, "hard", w, lv) for w, lv in (("1.00", "partial"), ("1.00", "missing"), ("0.75", "met"))]
    frame = spark.createDataFrame([(p, v, k, Decimal(w), lv) for p, v, k, w, lv in rows], "posting_id string, variant_id int, kind string, weight decimal(3,2), level string")
    got = scoring.coverage(frame).first()
    assert got["hard_coverage"] == Decimal("0.454545") and got["nice_coverage"] == Decimal("1.000000") and (got["hard_met"], got["hard_total"], got["hard_missing"]) == (1, 3, 1)
    scored = spark.createDataFrame([("p", 1, Decimal("71.60"), Decimal("0.90"), 0), ("p", 2, Decimal("72.00"), Decimal("0.55"), 2), ("p", 3, Decimal("70.00"), Decimal("0.99"), 0)], "posting_id string, variant_id int, composite_score decimal(5,2), hard_coverage decimal(9,6), hard_missing int")
    assert [r["variant_id"] for r in scoring.recommended(scored).filter("is_recommended").collect()] == [1]


def test_gaps(spark):
    rows = spark.createDataFrame([("p", 1, i, k, t, i, lv, None, None) for i, (k, t, lv) in enumerate([("nice", "a", "missing"), ("hard", "b", "partial"), ("hard", "c", "missing"), ("hard", "d", "met"), ("condition", "e", "missing")])], "posting_id string, variant_id int, requirement_id int, kind string, text string, ordinal int, level string, note string, evidence struct<bullet_id:string,text:string,claim_keys:array<string>>")
    found = scoring.gaps(rows)
    assert [g["text"] for g in found.first()["gaps"]] == ["c", "b", "a"]
    assert [g["text"] for g in found.select(scoring.blocking(F.col("gaps"))).first()[0]] == ["c"]
    assert {(r["kind"], r["text"], r["n"]) for r in scoring.gap_report(found).collect()} == {("hard", "c", 1), ("nice", "a", 1)}


@pytest.mark.parametrize(("pairs", "kappa"), [([("a", "a"), ("b", "b")], 1.0), ([("a", "b"), ("b", "a")], -1.0), ([("a", "a"), ("a", "a")], 1.0), ([], 1.0), ([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], 0.5)])
def test_kappa(spark, pairs, kappa):
    assert evaluation.cohen_kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()[0] == pytest.approx(kappa)


@pytest.mark.parametrize(("pairs", "rho"), [([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0)], 0.866), ([(1.0, 2.0), (2.0, 1.0)], -1.0), ([(1.0, 1.0), (1.0, 1.0)], 1.0), ([(1.0, 1.0), (1.0, 2.0)], 0.0), ([(1.0, 1.0)], 1.0)])
def test_rho(spark, pairs, rho):
    assert evaluation.spearman_rho(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()[0] == pytest.approx(rho, abs=1e-3)


def test_gates_and_regressions(spark):
    values = spark.createDataFrame([("hard_recall", 0.95), ("grounding_violations", 1.0)], "name string, value double")
    gates = evaluation.gates(values)
    assert {r["name"] for r in gates.collect() if r["passed"]} == {"hard_recall"}
    baseline = spark.createDataFrame([("hard_recall", 0.98), ("grounding_violations", 0.0), ("kind_accuracy", 0.01)], "name string, value double")
    assert {r["name"] for r in evaluation.regressions(gates, baseline).collect()} == {"hard_recall", "grounding_violations"}
    cases = spark.createDataFrame([("terse",), ("terse",)], "slice string")
    assert {tuple(r) for r in evaluation.slice_shortfall(cases, {"terse": 2, "verbose": 1}).collect()} == {("terse", 2, 2, False), ("verbose", 0, 1, True)}


def test_deciles_and_auc(spark):
    rows = spark.createDataFrame([(float(i), i >= 10) for i in range(20)], "s double, p boolean")
    assert evaluation.auc(rows, "s", "p").first()[0] == 1.0
    assert [r["rate"] for r in evaluation.decile_rates(rows, "s", "p").orderBy("decile").collect()] == [0.0] * 5 + [1.0] * 5


def test_registry_helpers(spark):
    row = spark.sql("SELECT map('z', '1', 'site', 'acme', 'api_key', 's') AS c, array(' Geo:IN', 'geo:in') AS good, array('bad:x') AS bad")
    got = row.select(reports.canonical_config(F.col("c")), reports.config_identity(F.col("c")), reports.redacted(F.col("c")), reports.clean_tags(F.col("good")), reports.clean_tags(F.col("bad"))).first()
    assert got[0] == '{"api_key":"s","site":"acme","z":"1"}' and got[1] == "site=acme" and got[2]["api_key"] == "***" and got[3] == ["geo:in"] and got[4] is None


def test_source_switches(spark):
    sources = spark.createDataFrame([(1, True, 3, "err", "ok"), (2, False, 0, None, "ok")], "id int, enabled boolean, consecutive_failures int, last_error string, last_status string")
    on = {r["id"]: r for r in reports.with_enabled(reports.with_enabled(sources, 1, True), 2, False, retired=True).collect()}
    assert (on[1]["consecutive_failures"], on[1]["last_error"]) == (0, None) and on[2]["last_status"] == "retired"
    left, kept, gone = reports.without_source(sources, spark.createDataFrame([(1,), (1,), (2,)], "source_id int"), 1)
    assert left.count() == 1 and kept.count() == 1 and gone.first()[0] == 2
