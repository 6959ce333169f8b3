"""Boards, mails, seeds, sinks and streams on invented files."""

import base64
import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import boards, contracts, landing, mail, plugin, seeds, sinks
from millrace.streaming import closing, events

TEXT = "&lt;p&gt;We build tools.&lt;/p&gt;&lt;ul&gt;&lt;li&gt;Python&lt;/li&gt;&lt;/ul&gt;"


def landed(tmp_path, payload, name="board.json"):
    (tmp_path / name).write_text(json.dumps(payload), encoding="utf-8")
    return str(tmp_path)


def test_greenhouse(spark, tmp_path):
    jobs = [
        {"id": 1, "absolute_url": "https://b.io/1", "title": "Senior Engineer", "content": TEXT, "updated_at": "2024-03-01T10:00:00-05:00", "location": {"name": "Pune, India"}, "departments": [{"id": 1, "name": "Eng", "parent_id": None}, {"id": 2, "name": "Core", "parent_id": 1}], "offices": [{"id": 1, "name": "Remote office"}], "metadata": [{"name": "Employment Type", "value": ["Full-time"]}]},
        {"id": 2, "absolute_url": "https://b.io/2", "title": "Analyst", "content": None, "departments": None, "offices": None, "metadata": None},
        {"id": 3, "absolute_url": "https://b.io/3", "title": "Intern", "content": "x", "metadata": [{"name": "employment type", "value": "Intern"}], "departments": [{"name": "Only"}]},
    ]
    got = {r["external_id"]: r for r in boards.greenhouse(spark, landed(tmp_path, {"jobs": jobs}), 7).collect()}
    assert set(got) == {"1", "3"}
    row = got["1"]
    assert (row["source_id"], row["department"], row["location_city"], row["location_country"], row["is_remote"], row["employment_type"], row["seniority_guess"]) == (7, "Core", "Pune", "IN", True, "full_time", "senior")
    assert row["posted_at"] == dt.datetime(2024, 3, 1, 15) and row["description_text"] == "We build tools.\n\n• Python" or row["description_text"] == "We build tools.\n• Python"
    assert row["description_html"].startswith("<p>") and json.loads(row["raw"])["offices"][0]["name"] == "Remote office"
    assert (got["3"]["employment_type"], got["3"]["department"], got["3"]["posted_at"]) == ("internship", "Only", None)
    assert [tuple(r) for r in boards.skipped(spark, str(tmp_path), "greenhouse").collect()] == [("no_description", 1)]


def test_a_broken_board_yields_nothing(spark, tmp_path):
    (tmp_path / "board.json").write_text('{"jobs": [{"id": "no number"}', encoding="utf-8")
    with pytest.raises(Exception):
        boards.greenhouse(spark, str(tmp_path), 1).collect()


def test_lever(spark, tmp_path):
    one = {"id": "a", "text": "Staff Engineer", "hostedUrl": "https://l.io/a", "createdAt": 1709287200000, "workplaceType": "remote", "categories": {"commitment": "Contract", "team": "Infra", "location": None, "allLocations": ["Berlin", "Pune"]}, "description": "<p>Intro</p>", "lists": [{"text": "You <do>", "content": "<li>build</li><li>run</li>"}, {"text": None, "content": None}], "additional": "<div>End</div>"}
    two = {"id": "b", "text": "X", "hostedUrl": "https://l.io/b", "categories": None, "lists": None}
    landed(tmp_path, [one, two], "page0.json")
    landed(tmp_path, [one], "page1.json")
    got = boards.lever(spark, str(tmp_path), 3).collect()
    assert len(got) == 1
    row = got[0]
    assert row["description_text"] == "Intro\n\nYou <do>\n• build\n• run\n\nEnd"
    assert row["description_html"] == "<p>Intro</p>\n<h3>You &lt;do&gt;</h3>\n<ul><li>build</li><li>run</li></ul>\n<div>End</div>"
    assert (row["department"], row["location_city"], row["is_remote"], row["employment_type"], row["posted_at"]) == ("Infra", "Berlin", True, "contract", dt.datetime(2024, 3, 1, 10))


def test_ashby(spark, tmp_path):
    jobs = [
        {"id": "a", "title": "Dev", "jobUrl": "https://a.io/a", "location": "London", "secondaryLocations": [{"location": "Remote - US"}], "publishedAt": "2024-03-01T00:00:00.000Z", "isListed": None, "isRemote": None, "descriptionPlain": "Plain text", "department": "D", "compensation": {"x": 1}},
        {"id": "b", "title": "Hidden", "jobUrl": "https://a.io/b", "isListed": False, "descriptionPlain": "x"},
    ]
    got = boards.ashby(spark, landed(tmp_path, {"jobs": jobs}), 4).collect()
    assert [(r["external_id"], r["is_remote"], r["location_country"], r["location_city"], r["department"]) for r in got] == [("a", True, None, "London", "D")]
    assert [tuple(r) for r in boards.skipped(spark, str(tmp_path), "ashby").collect()] == [("unlisted", 1)]


def test_adapters():
    assert boards.reader_of("lever") is boards.lever
    with pytest.raises(ValueError):
        boards.reader_of("nope")


def mailbox(path, mails):
    """Lands (sender, day, id, millis) as files of their folders."""
    for sender, day, id, millis in mails:
        folder = path / f"sender={sender}" / f"day={day}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{id}.json").write_text(json.dumps({"id": id, "internalDate": str(millis)}) + "\n")


def test_sources_take_predicates_over(spark, tmp_path):
    day = 1709251200000  # 2024-03-01
    mailbox(tmp_path, [(s, f"2024-03-0{d + 1}", f"{s}{d}", day + d * 86_400_000 + 3_600_000) for s in "abc" for d in range(4)])
    (tmp_path / "sender=a" / "day=2024-03-04" / "_half").write_text("{")  # still being written
    mails = plugin.registered(spark).read.format("millrace_mail").load(str(tmp_path))
    assert mails.count() == 12 and mails.rdd.getNumPartitions() == 12
    since = dt.datetime(2024, 3, 2, 1, 0, 0)
    wanted = mails.filter(F.col("sender").isin("a", "b") & (F.col("received_at") >= F.lit(since)))
    assert wanted.rdd.getNumPartitions() == 6  # folders of other senders and earlier days were not opened
    assert {r["message_id"] for r in wanted.collect()} == {"a1", "a2", "a3", "b1", "b2", "b3"}
    assert wanted.first()["asked"] == f"from:(a OR b) after:{(day + 86_400_000 + 3_600_000) // 1000}"
    assert "Filter" not in wanted._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # nothing is left to do above the scan
    later = mails.filter((F.col("sender") == "c") & (F.col("received_at") > F.lit(since)) & (F.col("message_id") != "c3"))
    assert {r["message_id"] for r in later.collect()} == {"c2"}
    narrow = plugin.registered(spark).read.format("millrace_mail").schema("message_id string").load(str(tmp_path))
    assert narrow.columns == ["message_id"] and narrow.count() == 12
    assert plugin.registered(spark).read.format("millrace_mail").load(f"{tmp_path}/none").count() == 0


def test_source_streams_go_on_where_they_stopped(spark, tmp_path):
    box = tmp_path / "box"
    mailbox(box, [("a", "2024-03-01", "one", 1709251200000), ("b", "2024-03-01", "two", 1709251200000)])

    def run():
        stream = plugin.registered(spark).readStream.format("millrace_mail").options(senders="a").load(str(box)).select("message_id")
        return [r["message_id"] for r in events.drained(stream, f"{tmp_path}/c", "append").collect()]

    assert run() == ["one"]
    mailbox(box, [("a", "2024-03-02", "three", 1709337600000), ("b", "2024-03-02", "four", 1709337600000)])
    assert sorted(run()) == ["one", "three"] and sorted(run()) == ["one", "three"]


def test_landed_boards_by_source(spark, tmp_path):
    for source in (5, 6):
        folder = tmp_path / f"source_id={source}" / "adapter=lever"
        folder.mkdir(parents=True)
        (folder / "1.json").write_text(json.dumps({"fetched_ms": 1709251200000, "page": [{"id": source}]}))
    rows = plugin.registered(spark).read.format("millrace_board").load(str(tmp_path)).filter("source_id = 6 and adapter = 'lever'")
    assert [(r["source_id"], r["adapter"], json.loads(r["value"]), r["asked"]) for r in rows.collect()] == [(6, "lever", [{"id": 6}], "")] and rows.rdd.getNumPartitions() == 1


CARD = """<html><style>x</style><table><tr><td><a href="https://www.linkedin.com/help">Help</a><a href="https://www.linkedin.com/jobs/view/1"></a></td></tr></table>
<table><tr><td><table><tr><td><a href="https://www.linkedin.com/jobs/view/77/?utm_x=1">ML Engineer</a><p>Acme Labs</p><p>Bengaluru, India</p><p>Actively hiring</p><p>3 days ago</p><p>A snippet that is long enough to be one, surely.</p></td></tr></table></td></tr></table></html>"""


def resource(body=CARD, sender="LinkedIn <jobs@linkedin.com>", id="m1", millis="1709287200000"):
    data = base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")
    return json.dumps({"id": id, "internalDate": millis, "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "From", "value": sender}, {"name": "Subject", "value": "s"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": data}}]}]}})


def test_mail_leads(spark):
    raw = [resource(), resource(id="m2", millis="1709200800000"), resource(sender="a@evil.io", id="m3"), "broken", resource(id="m4", millis="x"), resource(body="<p>no cards</p>", id="m5")]
    frame = spark.createDataFrame([(r,) for r in raw], "value string")
    since = F.lit("2024-01-01").cast("timestamp")
    mails = mail.messages(frame, ["jobs@linkedin.com"], since)
    assert {r["message_id"] for r in mails.collect()} == {"m1", "m2", "m5"} and mail.messages(frame, [], since).count() == 0
    got = mail.leads(mails, 9).collect()
    assert len(got) == 1
    row = got[0]
    extra = json.loads(row["raw"])
    assert (row["title"], row["company_name"], row["location_city"], row["posted_at"]) == ("ML Engineer", "Acme Labs", "Bengaluru", dt.datetime(2024, 2, 27))
    assert extra["linkedin_job_id"] == "77" and extra["email_message_id"] == "m1" and row["url"] == "https://www.linkedin.com/jobs/view/77/"
    assert row["description_text"].split("\n")[0] == "Discovered via linkedin job alert email received 2024-03-01."
    assert {r["message_id"] for r in mail.parse_misses(mails).collect()} == {"m5"}
    assert mail.search_query("L", ["a", "b"], 5) == 'label:"L" from:(a OR b) after:5'


def test_card_parts(spark):
    long = "a snippet of forty characters or more, yes it is"
    rows = [(["Promoted", "Acme", "Pune", "x"], ("Acme", "Pune", None)), (["Acme", "Somewhere"], ("Acme", "Somewhere", None)), (["Viewed"], (None, None, None)), (["Zeta India", long, "Remote", "Berlin"], ("Zeta India", "Remote", long)), (["A", long, "other"], ("A", "other", long)), ([], (None, None, None))]
    frame = spark.createDataFrame([(i, [(x, x) for x in lines]) for i, (lines, _) in enumerate(rows)], "i int, lines array<struct<line:string,plain:string>>")
    got = frame.select("i", mail.card_parts(F.col("lines")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["company_name"], r["p"]["location_raw"], r["p"]["snippet"]) for r in got] == [want for _, want in rows]


def test_card_lines_take_the_fullest_element_up_to_the_card(spark):
    rows = [
        ([("p", "T"), ("td", "T\nAcme"), ("tr", "T\nAcme"), ("table", "T\nAcme\nPune\nx")], ["Acme", "Pune", "x"]),  # one line is no card
        ([("td", "T\nAcme\nPune"), ("tr", "T\n Acme \nPune"), ("table", "T\nA\nB\nC")], ["Acme", "Pune"]),
        ([("div", "T\na"), ("div", "T\na\nb"), ("div", "T\nc\nd")], ["a", "b"]),
        ([], None),
    ]
    frame = spark.createDataFrame([(i, [(*x, x[1]) for x in levels]) for i, (levels, _) in enumerate(rows)], "i int, levels array<struct<tag:string,text:string,plain:string>>")
    got = frame.select("i", mail.card_lines(F.col("levels"), F.lit("T")).alias("l")).orderBy("i").collect()
    assert [None if r["l"] is None else [x["line"] for x in r["l"]] for r in got] == [want for _, want in rows]


def test_seeds(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"version": "v1", "skills": [{"token": "aws", "family": "cloud", "aliases": ["amazon web services"]}]}))
    (tmp_path / "a.json").write_text(json.dumps({"families": {"cloud": 0.6}}))
    assert seeds.load_vocabulary(spark, tmp_path / "v.json", tmp_path / "a.json").aliases["amazon web services"] == "aws"
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"slug": "a", "name": "A", "sources": [{"adapter": "lever", "config": {"site": "a"}}]}]}))
    companies, sources = seeds.load_companies(spark, tmp_path / "c.json")
    assert companies.count() == sources.count() == 1
    (tmp_path / "claims.json").write_text(json.dumps({"claims": [{"key": "k", "statement": "TODO", "verdict": "yes"}]}))
    with pytest.raises(seeds.SeedError):
        seeds.load_claims(spark, tmp_path / "claims.json")
    golden = tmp_path / "golden"
    golden.mkdir()
    (golden / "1.yaml").write_text("id: '1'\nslice: terse\njd_text_file: 1.txt\n")
    (golden / "1.txt").write_text("text")
    assert seeds.load_cases(spark, golden).first()["text"] == "text"


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.swapped(spark.range(5), path)
    first = sinks.current(spark, path)
    sinks.swapped(first.filter("id > 1"), path)  # reads what it replaces
    assert sinks.current(spark, path).count() == 3 and first.count() == 5  # readers of the version before go on
    sinks.swapped(sinks.current(spark, path).filter("id > 2"), path)
    assert sinks.current(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{tmp_path}/none")
    scores = spark.createDataFrame([("v1", 1), ("v2", 2)], "prompt_version string, s int")
    sinks.replace_partitions(scores, f"{tmp_path}/s", "prompt_version")
    sinks.replace_partitions(scores.filter("s = 2").withColumn("s", F.lit(9)), f"{tmp_path}/s", "prompt_version")
    assert sorted(r["s"] for r in sinks.current(spark, f"{tmp_path}/s").collect()) == [1, 9]
    assert sinks.as_json(scores).orderBy("value").first()[0] == '{"prompt_version":"v1","s":1}'
    assert sinks.as_table(scores).splitlines()[0] == "prompt_version  s"


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"k{i % 4}", ["submitted", "acknowledged", "offer", "rejected"][i % 4 if i % 5 else 0], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, application_id string, status string, occurred_at timestamp")
    frame.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.file_stream(spark, f"{tmp_path}/in/*.parquet", frame.schema, 1)
    from millrace.plans.funnel import folded_status

    got = events.drained(events.status_stream(stream), f"{tmp_path}/c1", "complete").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in folded_status(frame).collect()}
    once = events.drained(events.without_repeats(events.file_stream(spark, f"{tmp_path}/in/*.parquet", frame.schema), "application_id", "occurred_at", "48 hours"), f"{tmp_path}/c2", "append")
    assert once.count() == 4


def test_streamed_close_rule(spark, tmp_path):
    """Against a loop over the runs: failed runs freeze, closed postings leave and may come again."""
    rnd, day = random.Random(4), dt.datetime(2024, 1, 1)
    runs = [{source: (rnd.choice(["ok", "empty", "http_error", "ok"]), sorted(rnd.sample("abcdefgh", rnd.randint(0, 6)))) for source in (1, 2)} for _ in range(9)]
    want, missed = set(), {1: {}, 2: {}}
    for n, run in enumerate(runs):
        at = day + dt.timedelta(days=n)
        rows = []
        for source, (status, seen) in run.items():
            if status != "http_error":
                rows += [(source, x, at, None) for x in seen]
                for x in set(missed[source]) | set(seen):
                    before = missed[source].get(x, 0)
                    after = 0 if x in seen else before + 1
                    want.add((source, x, at, after, after >= 2))
                    missed[source][x] = after
                    if after >= 2:
                        del missed[source][x]
            rows.append((source, None, at, status))
        spark.createDataFrame(rows, "source_id long, external_id string, run_at timestamp, status string").coalesce(1).write.parquet(f"{tmp_path}/in/r{n}")
    stream = events.file_stream(spark, f"{tmp_path}/in/*/*.parquet", "source_id long, external_id string, run_at timestamp, status string", 2)
    got = events.drained(closing.close_stream(stream, shards=3), f"{tmp_path}/c", "update").drop("batch").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_upsert_stream(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    events.upsert_stream(events.file_stream(spark, f"{tmp_path}/in/*.parquet", "id long"), lambda df, n: seen.append(df.count()), f"{tmp_path}/c").awaitTermination()
    assert sum(seen) == 3


def lands(tmp_path, source, run, adapter, pages, status="ok", files=None, manifest=True):
    folder = tmp_path / f"source_id={source}" / f"run={run}"
    folder.mkdir(parents=True)
    for name, content in pages.items():
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    if manifest:
        sizes = [{"name": name, "bytes": (folder / name).stat().st_size} for name in pages]
        (folder / landing.MANIFEST).write_text(json.dumps({"adapter": adapter, "status": status, "files": sizes if files is None else files}))


def test_one_source_fails_by_itself(spark, tmp_path):
    job = lambda n: {"id": n, "absolute_url": f"https://b.io/{n}", "title": "Engineer", "content": "<p>x</p>"}
    post = lambda n: {"id": n, "text": "Dev", "hostedUrl": "https://l.io/a", "descriptionPlain": f"text {n}"}
    lands(tmp_path, 1, "r1", "greenhouse", {"p0.json": {"jobs": [job(1)]}, "p1.json": json.dumps({"jobs": [job(2)]}, indent=1)})
    lands(tmp_path, 2, "r1", "greenhouse", {"p0.json": {"jobs": [job(3)]}, "p1.json": '{"jobs": [{"id": 4, "tit'})
    lands(tmp_path, 3, "r1", "lever", {"p0.json": [post("a"), post("b")], "p1.json": [post("b")]})
    lands(tmp_path, 4, "r1", "lever", {"p0.json": [post("c"), {"text": "without id"}]})
    lands(tmp_path, 5, "r1", "ashby", {"p0.json": {"jobs": []}}, status="empty")
    lands(tmp_path, 6, "r1", "ashby", {"p0.json": {"jobs": []}}, files=[{"name": "p0.json", "bytes": 12}, {"name": "p9.json", "bytes": 5}])
    lands(tmp_path, 7, "r1", "ashby", {"p0.json": {"jobs": []}}, manifest=False)
    lands(tmp_path, 8, "r1", "lever", {"p0.json": []}, status="http_error")
    lands(tmp_path, 9, "r1", "workday", {"p0.json": []})
    lands(tmp_path, 10, "r1", "greenhouse", {"p0.json": {"jobs": [{"id": "five"}]}})
    lands(tmp_path, 1, "r2", "greenhouse", {"p0.json": {"jobs": [job(1)]}}, files=[{"name": "p0.json", "bytes": 7}])
    rows, ended = landing.postings(spark, str(tmp_path))
    told = {(r["source_id"], r["run"]): (r["status"], r["detail"]) for r in ended.collect()}
    assert told == {
        (1, "r1"): ("ok", None), (1, "r2"): ("incomplete", "p0.json of another length"), (2, "r1"): ("schema_error", "p1.json doesn't parse"), (3, "r1"): ("ok", None), (4, "r1"): ("schema_error", "p0.json doesn't parse"), (5, "r1"): ("empty", None),
        (6, "r1"): ("incomplete", "p9.json absent"), (7, "r1"): ("incomplete", "no manifest"), (8, "r1"): ("http_error", None), (9, "r1"): ("schema_error", "no adapter workday"), (10, "r1"): ("schema_error", "p0.json doesn't parse"),
    }
    assert sorted((r["source_id"], r["run"], r["external_id"]) for r in rows.collect()) == [(1, "r1", "1"), (1, "r1", "2"), (3, "r1", "a"), (3, "r1", "b")]


def test_many_pages_a_file(spark, tmp_path):
    post = lambda n, text="t": {"id": n, "text": "Dev", "hostedUrl": "https://l.io/a", "descriptionPlain": f"{text} {n}"}
    lines = {1: [[post("a"), post("b")], [post("b", "later"), post("c")]], 2: [[post("d")]]}
    for source, boards_pages in lines.items():
        lands(tmp_path, source, "r1", "lever", {"p.txt": "".join(json.dumps(page) + "\n" for page in boards_pages) + ('[{"id": "e", "te\n' if source == 2 else "")})
        manifest = tmp_path / f"source_id={source}" / "run=r1" / landing.MANIFEST
        manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"by_line": True}))
    rows, ended = landing.postings(spark, str(tmp_path))
    assert {r["source_id"]: (r["status"], r["detail"]) for r in ended.collect()} == {1: ("ok", None), 2: ("schema_error", "p.txt doesn't parse")}
    assert sorted((r["external_id"], r["description_text"]) for r in rows.collect()) == [("a", "t a"), ("b", "t b"), ("c", "t c")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 3  # pages of runs, pages of postings and their items: of lever only



def test_contract(spark):
    good = ("x", "https://a.io/1", "t", "text", "in", "full_time", dt.datetime(2024, 1, 1), None)
    kinds = "external_id string, url string, title string, description_text string, location_country string, employment_type string, posted_at timestamp, odd string"
    bad = {
        "external_id: too short": ("", *good[1:]), "external_id: too long": ("x" * 257, *good[1:]), "external_id: missing": (None, *good[1:]), "url: malformed": ("x", "ftp://a.io", *good[2:]), "title: too long": (*good[:2], "t" * 513, *good[3:]),
        "description_text: too short": (*good[:3], "", *good[4:]), "description_text: missing": (*good[:3], None, *good[4:]), "location_country: malformed": (*good[:4], "IND", *good[5:]), "employment_type: unknown value": (*good[:5], "gig", *good[6:]),
        "posted_at: out of time": (*good[:6], dt.datetime(1970, 1, 1), None), "odd: not in the contract": (*good[:7], "y"),
    }
    checked = contracts.POSTING.checked(spark.createDataFrame([good, *bad.values()], kinds))
    assert [r["violations"] for r in checked.collect()] == [[], *([what] for what in bad)]
    row = contracts.POSTING.good(checked).collect()
    assert len(row) == 1 and (row[0]["location_country"], row[0]["is_remote"], row[0]["seniority_guess"], row[0]["raw"]) == ("IN", False, "unknown", "{}") and tuple(row[0].asDict()) == contracts.POSTING.names
    kept = contracts.POSTING.quarantined(checked, ("external_id",)).collect()
    assert len(kept) == len(bad) and all(json.loads(r["given"]).get("title") or r["external_id"] is None for r in kept)


def test_contract_over_json(spark):
    texts = ['{"external_id":"x","url":"https://a.io","title":"t","description_text":"d","posted_at":"2024-01-01T00:00:00Z"}', '{"external_id":"x","url":"https://a.io","title":"t","description_text":"d","salary":1,"age":2}', '{"external_id":"x","url":"https://a.io","title":"t","description_text":"d","is_remote":"maybe"}', "nonsense", None, "[1]"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, value string")
    checked = contracts.POSTING.of_json(rows, carried=("n",))
    told = {r["n"]: r["violations"] for r in checked.collect()}
    assert told[0] == [] and told[1] == ["age: not in the contract", "salary: not in the contract"] and told[2] == ["record: malformed"]
    assert all(told[n][0] == "record: malformed" for n in (3, 4, 5))
    assert [r["n"] for r in contracts.POSTING.good(checked, ("n",)).collect()] == [0]


def plain_message(resource):
    """A message by a walk over its parts."""
    try:
        given = json.loads(resource)
    except (TypeError, ValueError):
        return None
    payload = given.get("payload") if isinstance(given, dict) and isinstance(given.get("payload"), dict) else {}
    headers = {}
    for h in payload.get("headers") or ():
        if isinstance(h.get("name"), str) and isinstance(h.get("value"), str):
            headers.setdefault(h["name"].lower(), h["value"])
    found = {}

    def walk(part, depth):
        if depth > 8:
            return
        kind, data = str(part.get("mimeType") or "").lower(), (part.get("body") or {}).get("data")
        if kind in ("text/html", "text/plain") and isinstance(data, str) and data and kind not in found:
            kept = "".join(c for c in data if c.isalnum() or c in "-_")
            if len(kept) % 4 != 1:
                found[kind] = base64.urlsafe_b64decode(kept + "=" * (-len(kept) % 4)).decode("utf-8", "replace")
        for below in part.get("parts") or ():
            walk(below, depth + 1)

    walk(payload, 0)
    sender = headers.get("from", "")
    sender = sender[sender.index("<") + 1 : sender.index(">")] if "<" in sender else sender.split(" (")[0].strip()
    millis = str(given.get("internalDate") or "")
    if not given.get("id") or not sender or not millis.lstrip("-").isdigit():
        return None
    return given["id"], sender, headers.get("subject", ""), millis, found.get("text/html"), found.get("text/plain")


def test_messages_against_a_walk(spark):
    rnd = random.Random(7)

    def tree(depth):
        kind = rnd.choice(["text/html", "TEXT/Plain", "multipart/mixed", "image/png", None])
        out = {"mimeType": kind} if kind else {}
        if rnd.random() < 0.6:
            out["body"] = {"data": rnd.choice(["", base64.urlsafe_b64encode(f"é {depth} {rnd.random()}".encode()).decode().rstrip("="), "abcde", 7, None, "_-8", base64.urlsafe_b64encode(b"\xff\xfe ok").decode()])}
        if depth < 11 and rnd.random() < 0.8:
            out["parts"] = [tree(depth + 1) for _ in range(rnd.randint(1, 2))]
        return out

    deep = {"mimeType": "text/html", "body": {"data": "aGk"}}
    for _ in range(9):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    senders = ["LinkedIn <jobs@linkedin.com>", "a@b.c", "a@b.c (Team)", '"Doe, J" <x@y.z>', ""]
    mails = [{"id": f"m{i}", "internalDate": rnd.choice(["1709287200000", 5, "soon", "-7"]), "payload": tree(0) | {"headers": [{"name": "FROM", "value": rnd.choice(senders)}, {"name": "Subject", "value": "s"}, {"name": "from", "value": "second@x.y"}, {"name": "odd"}]}} for i in range(120)]
    texts = [json.dumps(m) for m in mails] + [json.dumps({"id": "deep", "internalDate": "1", "payload": deep | {"headers": [{"name": "from", "value": "a@b.c"}]}}), "nonsense", None, "[]", "{}", '{"id": "x", "payload": 5}']
    rows = spark.createDataFrame([(x,) for x in texts], "value string")
    want = [m for m in map(plain_message, [x for x in texts if x != "[]"]) if m]
    assert sorted(map(repr, map(tuple, mail.parsed(rows).collect()))) == sorted(map(repr, want)) and len(want) > 40
    plan = mail.parsed(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mails_are_parsed_once_and_in_many_tasks(spark):
    """A file of one row group is dealt over tasks; a filter on what was parsed doesn't parse again."""
    from millrace import queries_sources

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf_dir):
        pytest.skip("no benchmark tables")
    assert queries_sources._mails(spark, sf_dir).rdd.getNumPartitions() > 1
    plan = queries_sources._received(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_small_landed_files_share_tasks(tmp_path):
    """Every file once and in order, in no more than 64 groups while they are small."""
    for k in range(200):
        (tmp_path / f"sender=s{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"sender=s{k % 2}" / f"{k}.txt").write_text("{}")
    found = [plugin.LandedFile(path, parts, plugin.Wanted()) for _, path, parts in plugin.landed(str(tmp_path))]
    groups = plugin.packed(found, str(tmp_path))
    assert len(groups) <= 64 and [f.path for g in groups for f in g.files] == [f.path for f in found]
    assert plugin.packed([], str(tmp_path)) == []
