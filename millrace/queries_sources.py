"""Registered queries of boards, alert mails and streams, and their SQL.

The scans read landed files: each query first lands responses made of benchmark
rows in a new folder below the shared one.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query, table, with_
from millrace.functions import html
from millrace.operators import ingest
from millrace.plans.standins import run
from millrace.session import shared_folder
from millrace.settings import DEFAULT
from millrace.sources import boards, contracts, files, keyed, landing, mail, plugin
from millrace.streaming import events

#: Jobs of boards of two hundred: where, what and how by the remainders of the id.
JOBS = """
SELECT doc_id AS id, CAST(floor(doc_id / 200) AS BIGINT) AS board, source, lang, doc_id % 4 AS place, doc_id % 3 AS kind, doc_id % 10 = 9 AS bare, doc_id % 6 = 5 AS hidden,
  CASE doc_id % 5 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'Data Intern' WHEN 2 THEN 'Platform Director' ELSE 'Analyst' END AS title
FROM documents
"""
_WHERE = "CASE place WHEN 0 THEN 'Bangalore, India' WHEN 1 THEN 'Remote - Germany' WHEN 2 THEN 'Paris' END"
_CITY = "CASE place WHEN 0 THEN 'Bengaluru' WHEN 2 THEN 'Paris' END"
_COUNTRY = "CASE place WHEN 0 THEN 'IN' WHEN 1 THEN 'DE' END"
_BAND = "CASE title WHEN 'Senior Engineer' THEN 'senior' WHEN 'Data Intern' THEN 'intern' WHEN 'Platform Director' THEN 'director' ELSE 'mid' END"
#: What the boards have in common, from SQL's side; the text is given.
_SHARED = f"CAST(id AS STRING) AS external_id, title, {_CITY} AS city, {_COUNTRY} AS country, {_BAND} AS seniority"


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows of one file, in as many tasks as run and a few more, ahead of what makes much of each: a file of one row group is one task else."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, JOBS).withColumn("where", F.expr(_WHERE))


def _landed(spark: SparkSession, responses: DataFrame) -> str:
    """Writes one file for each row of (board, value); its folder."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    responses.repartition("board").write.partitionBy("board").text(path)
    return path


def _shown(postings: DataFrame) -> DataFrame:
    return postings.select("external_id", "title", F.col("location_city").alias("city"), F.col("location_country").alias("country"), F.col("seniority_guess").alias("seniority"), "is_remote", "department", "employment_type", F.md5(F.col("description_text").cast("binary")).alias("text"), F.unix_seconds("posted_at").alias("posted"))


def _greenhouse(spark, sf_dir) -> str:
    content = F.concat(F.lit("<p>Build "), "source", F.lit(" &amp; more</p><ul><li>Item "), F.col("id").cast("string"), F.lit("</li></ul>"))

    def named(number: int, name: Column, parent: int | None = None) -> Column:
        return F.struct(F.lit(number).cast("long").alias("id"), name.alias("name"), F.lit(parent).cast("long").alias("parent_id"))

    job = F.struct(
        "id", F.concat(F.lit("https://b.example.com/"), F.col("id").cast("string")).alias("absolute_url"), "title",
        F.when(F.col("bare"), "").otherwise(html.escaped(content)).alias("content"),
        F.concat(F.lit("2024-02-0"), (F.col("kind") + 1).cast("string"), F.lit("T10:00:00-05:00")).alias("updated_at"),
        F.when(F.col("where").isNotNull(), F.struct(F.col("where").alias("name"))).alias("location"),
        F.when(F.col("kind") == 0, F.array(named(1, F.lit("")), named(2, F.lit("Company")), named(3, F.col("source"), 2))).when(F.col("kind") == 1, F.array(named(2, F.lit("Company")))).alias("departments"),
        F.when(F.col("place") == 3, F.array(named(1, F.lit("Remote EMEA")))).alias("offices"),
        F.when(F.col("kind") == 1, F.array(F.struct(F.lit("Employment Type ").alias("name"), F.lit("Full-time").alias("value")))).alias("metadata"),
    )
    jobs = _jobs(spark, sf_dir)
    return _landed(spark, jobs.groupBy("board").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value")))


@query("greenhouse_postings", with_(j=JOBS) + f"""SELECT {_SHARED}, place IN (1, 3) AS is_remote, CASE kind WHEN 0 THEN source WHEN 1 THEN 'Company' END AS department, CASE kind WHEN 1 THEN 'full_time' ELSE 'unknown' END AS employment_type,
md5('Build ' || source || ' & more' || chr(10) || '• Item ' || id) AS text, CAST(epoch(TIMESTAMP '2024-02-01 15:00:00') AS BIGINT) + kind * 86400 AS posted FROM j WHERE NOT bare""")
def greenhouse_postings(spark, sf_dir):
    return _shown(boards.greenhouse(spark, _greenhouse(spark, sf_dir), 1))


def _lever(spark, sf_dir) -> str:
    j = _jobs(spark, sf_dir)
    part = F.struct(F.lit(" Needs ").alias("text"), F.concat(F.lit("<li>Item "), F.col("id").cast("string"), F.lit("</li>")).alias("content"))
    post = F.struct(
        F.col("id").cast("string").alias("id"), F.col("title").alias("text"), F.concat(F.lit("https://l.example.com/"), F.col("id").cast("string")).alias("hostedUrl"),
        (F.lit(1706788800000) + F.col("kind") * 1000).alias("createdAt"), F.when(F.col("place") == 3, " Remote ").alias("workplaceType"),
        F.struct(F.when(F.col("kind") == 0, "Contractor").alias("commitment"), F.lit("Dept").alias("department"), F.when(F.col("kind") == 1, F.col("source")).alias("team"), F.when(F.col("place") != 2, F.col("where")).alias("location"), F.array("where").alias("allLocations")).alias("categories"),
        F.when(F.col("bare"), "").otherwise(F.concat(F.lit("<div>Build "), "source", F.lit("</div>"))).alias("description"),
        F.when(~F.col("bare"), F.array(part)).alias("lists"), F.when(F.col("kind") == 2, "<p>Apply</p>").alias("additional"),
    )
    # a page that repeats what another one had
    paged = j.unionByName(j.filter("id % 5 = 0").withColumn("board", F.col("board") + 1_000_000))
    return _landed(spark, paged.filter("not (bare and kind = 2)").groupBy("board").agg(F.to_json(F.collect_list(post)).alias("value")))


@query("lever_postings", with_(j=JOBS) + f"""SELECT {_SHARED}, place IN (1, 3) AS is_remote, CASE kind WHEN 1 THEN source ELSE 'Dept' END AS department, CASE kind WHEN 0 THEN 'contract' ELSE 'unknown' END AS employment_type,
md5('Build ' || source || chr(10) || chr(10) || 'Needs' || chr(10) || '• Item ' || id || CASE kind WHEN 2 THEN chr(10) || chr(10) || 'Apply' ELSE '' END) AS text, 1706788800 + kind AS posted FROM j WHERE NOT bare""")
def lever_postings(spark, sf_dir):
    return _shown(boards.lever(spark, _lever(spark, sf_dir), 2))


def _ashby(spark, sf_dir) -> str:
    other = F.struct(F.when(F.col("kind") == 2, "Remote (US)").otherwise("Oslo").alias("location"))
    job = F.struct(
        F.col("id").cast("string").alias("id"), "title", F.lit("https://a.example.com/x").alias("jobUrl"), F.col("source").alias("department"), F.when(F.col("kind") == 0, "").alias("team"),
        F.when(F.col("kind") == 2, "PartTime").alias("employmentType"), F.col("where").alias("location"), F.array(other).alias("secondaryLocations"), F.lit("2024-02-01T00:00:00.000+00:00").alias("publishedAt"),
        F.when(F.col("hidden"), False).alias("isListed"), F.when(F.col("place") == 3, True).alias("isRemote"),
        F.when(~F.col("bare"), F.concat(F.lit("<h1>Build</h1>"), "source")).alias("descriptionHtml"), F.when(F.col("kind") == 1, "").alias("descriptionPlain"),
    )
    return _landed(spark, _jobs(spark, sf_dir).groupBy("board").agg(F.to_json(F.struct(F.lit("1").alias("apiVersion"), F.collect_list(job).alias("jobs"))).alias("value")))


@query("ashby_postings", with_(j=JOBS) + f"""SELECT {_SHARED}, place IN (1, 3) OR kind = 2 AS is_remote, source AS department, CASE kind WHEN 2 THEN 'part_time' ELSE 'unknown' END AS employment_type, md5('Build' || source) AS text, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) AS posted FROM j WHERE NOT bare AND NOT hidden""")
def ashby_postings(spark, sf_dir):
    return _shown(boards.ashby(spark, _ashby(spark, sf_dir), 3))


@query("skipped_of_boards", with_(j=JOBS) + """SELECT 'greenhouse' AS adapter, 'no_description' AS reason, count(*) AS n FROM j WHERE bare UNION ALL SELECT 'ashby', CASE WHEN hidden THEN 'unlisted' ELSE 'no_description' END, count(*) FROM j WHERE hidden OR bare GROUP BY 2
UNION ALL SELECT 'lever', 'duplicate', count(*) FROM j WHERE id % 5 = 0 AND NOT (bare AND kind = 2) UNION ALL SELECT 'lever', 'no_description', count(*) FROM j WHERE bare AND kind <> 2""")
def skipped_of_boards(spark, sf_dir):
    parts = [boards.skipped(spark, land(spark, sf_dir), name).select(F.lit(name).alias("adapter"), "reason", "n") for name, land in (("greenhouse", _greenhouse), ("lever", _lever), ("ashby", _ashby))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("boards_by_adapter", with_(j=JOBS) + "SELECT 'ashby' AS adapter, count(*) AS n FROM j WHERE NOT bare AND NOT hidden UNION ALL SELECT 'greenhouse', count(*) FROM j WHERE NOT bare")
def boards_by_adapter(spark, sf_dir):
    counts = [boards.reader_of(name)(spark, land(spark, sf_dir), 1).agg(F.count("*").alias("n")).select(F.lit(name).alias("adapter"), "n") for name, land in (("ashby", _ashby), ("greenhouse", _greenhouse))]
    return counts[0].unionByName(counts[1])


# ---------------------------------------------------------------- landed runs, row contracts


def _runs(spark, sf_dir) -> str:
    """Every source lands one run of lever pages with the texts of its documents, a page a line; four of them go wrong in a way of their own."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("source_id"), F.lit("r1").alias("run"), F.floor(F.col("doc_id") / 300).alias("page"), F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("text"), F.lit("https://l.example.com/x").alias("hostedUrl"), F.col("text").alias("descriptionPlain")).alias("post"))
    pages = d.groupBy("source_id", "run", "page").agg(F.to_json(F.collect_list("post")).alias("value"))
    cut = F.when((F.col("source_id") == 2) & (F.col("page") == 0), F.left("value", F.length("value") - 3)).otherwise(F.col("value"))
    # some MB a file, a folder for each run
    pages.withColumn("value", cut).select("source_id", "run", "value").write.partitionBy("source_id", "run").option("maxRecordsPerFile", 64).text(path)
    # what a downloader writes last; one short text a source
    folder = files.Folder(spark, path)
    listed = F.collect_list(F.struct("name", "bytes"))
    for row in landing.files(spark, path).groupBy("source_id").agg(F.to_json(F.struct(F.lit("lever").alias("adapter"), F.when(F.col("source_id") == 9, "http_error").otherwise("ok").alias("status"), F.when(F.col("source_id") == 5, F.concat(listed, F.array(F.struct(F.lit("gone.json").alias("name"), F.lit(1).cast("long").alias("bytes"))))).otherwise(listed).alias("files"), F.lit(True).alias("by_line"))).alias("manifest")).collect():
        if row["source_id"] != 7:
            folder.create(f"source_id={row['source_id']}/run=r1/{landing.MANIFEST}", row["manifest"])
    return path


_SOURCE = "CAST(substr(source, 4) AS BIGINT)"


@query("landed_runs", f"SELECT DISTINCT {_SOURCE} AS source_id, CASE {_SOURCE} WHEN 2 THEN 'schema_error' WHEN 5 THEN 'incomplete' WHEN 7 THEN 'incomplete' WHEN 9 THEN 'http_error' ELSE 'ok' END AS status, CASE {_SOURCE} WHEN 2 THEN 'doesn''t parse' WHEN 5 THEN 'gone.json absent' WHEN 7 THEN 'no manifest' END AS detail FROM documents")
def landed_runs(spark, sf_dir):
    ended = landing.postings(spark, _runs(spark, sf_dir))[1]
    return ended.select("source_id", "status", F.regexp_replace("detail", "^part-.* (?=doesn't)", "").alias("detail"))


@query("landed_postings", f"SELECT {_SOURCE} AS source_id, CAST(doc_id AS STRING) AS external_id, lang AS title, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM documents WHERE {_SOURCE} NOT IN (2, 5, 7, 9) AND regexp_matches(text, '\\S')".replace("\\\\", "\\"))
def landed_postings(spark, sf_dir):
    """Whole texts through the scan of all sources; those that went wrong have no rows, the others all of theirs."""
    rows = landing.postings(spark, _runs(spark, sf_dir), replace(DEFAULT, max_description_chars=100_000_000))[0]
    return rows.select("source_id", "external_id", "title", F.md5(F.col("description_text").cast("binary")).alias("text"))


_GIVEN = """SELECT doc_id AS n, CASE WHEN doc_id % 7 <> 1 THEN CAST(doc_id AS STRING) ELSE CASE WHEN doc_id % 2 = 0 THEN '' END END AS external_id, CASE WHEN doc_id % 5 = 2 THEN source ELSE 'https://jobs.example.com/' || source END AS url,
  CASE WHEN doc_id % 11 = 3 THEN repeat(lang, 300) ELSE lang END AS title, text AS description_text, CASE doc_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'Germany' END AS location_country,
  CASE doc_id % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'gig' END AS employment_type, CASE doc_id % 9 WHEN 0 THEN TIMESTAMP '1969-12-31 00:00:00' WHEN 1 THEN TIMESTAMP '2024-05-01 00:00:00' END AS posted_at, CASE WHEN doc_id % 13 = 0 THEN 'x' END AS salary FROM documents"""
_WRONG = """list_filter([CASE WHEN salary IS NOT NULL THEN 'salary: not in the contract' END, CASE WHEN external_id IS NULL THEN 'external_id: missing' WHEN external_id = '' THEN 'external_id: too short' END, CASE WHEN n % 5 = 2 THEN 'url: malformed' END, CASE WHEN length(title) > 512 THEN 'title: too long' END,
CASE WHEN description_text IS NULL THEN 'description_text: missing' WHEN description_text = '' THEN 'description_text: too short' END, CASE WHEN n % 4 = 1 THEN 'location_country: malformed' END, CASE WHEN n % 6 = 1 THEN 'employment_type: unknown value' END, CASE WHEN n % 9 = 0 THEN 'posted_at: out of time' END], lambda x: x IS NOT NULL)"""


@query("contract_violations", with_(g=_GIVEN) + f"SELECT n, array_to_string(w, '; ') AS wrong FROM (SELECT n, {_WRONG} AS w FROM g) WHERE len(w) > 0")
def contract_violations(spark, sf_dir):
    """What was wrong with the rows that go to quarantine."""
    checked = contracts.POSTING.checked(run(spark, sf_dir, _GIVEN), ("n",))
    return contracts.POSTING.quarantined(checked, ("n",)).select("n", F.array_join("violations", "; ").alias("wrong"))


@query("contract_rows", with_(g=_GIVEN) + f"SELECT n, external_id, url, md5(description_text) AS text, upper(location_country) AS location_country, coalesce(employment_type, 'unknown') AS employment_type, 'unknown' AS seniority, false AS is_remote FROM g WHERE len({_WRONG}) = 0")
def contract_rows(spark, sf_dir):
    """The rows that go on, as the contract normalises them."""
    rows = contracts.POSTING.good(contracts.POSTING.checked(run(spark, sf_dir, _GIVEN), ("n",)), ("n",))
    return rows.select("n", "external_id", "url", F.md5(F.col("description_text").cast("binary")).alias("text"), "location_country", "employment_type", F.col("seniority_guess").alias("seniority"), "is_remote")


# ---------------------------------------------------------------- alert mails

#: A mail per customer: its platform, the job's key, what the card says, and when it came.
MAILS = """
SELECT c_custkey AS id, c_custkey % 4 AS sender, c_custkey + 10000000 AS job, c_name AS company, c_custkey % 5 AS place, c_custkey % 3 AS kind, 1709287200 + c_custkey * 60 AS came FROM customer
"""
_PLATFORM = "CASE sender WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'naukri' END"
_PLACE = "CASE place WHEN 0 THEN 'Pune, India' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Mumbai (All Areas)' WHEN 3 THEN 'Zürich' END"


def _mails(spark, sf_dir) -> DataFrame:
    m = _dealt(run(spark, sf_dir, MAILS), "id").withColumn("platform", F.expr(_PLATFORM)).withColumn("where", F.expr(_PLACE))
    job = F.col("job").cast("string")
    link = (
        F.when(m["sender"] == 0, F.concat(F.lit("https://www.linkedin.com/comm/jobs/view/"), job, F.lit("/?trk=x&refId=9")))
        .when(m["sender"] == 1, F.concat(F.lit("https://cts.indeed.com/v3/x?jk="), F.lower(F.hex(m["job"] + 1_000_000_000)), F.lit("&from=mail")))
        .when(m["sender"] == 2, F.concat(F.lit("https://www.naukri.com/job-listings-dev-at-x-"), job, F.lit("?src=mail")))
        .otherwise(F.lit("https://www.example.com/jobs/view/5"))
    )
    line = lambda text: F.concat(F.lit("<p>"), text, F.lit("</p>"))
    card = F.concat(
        F.lit('<html><style>p{}</style><a href="https://www.example.com/help">Help</a><table><tr><td><a href="'), html.escaped(link), F.lit('"> ML&nbsp;Engineer '), F.when(m["kind"] == 0, "II").otherwise(""), F.lit("</a><p>Promoted</p>"),
        line("company"), F.coalesce(line("where"), F.lit("")), F.when(m["kind"] == 1, line(F.lit("3 days ago"))).when(m["kind"] == 2, line(F.lit("4 - 7 Yrs"))).otherwise(line(F.lit("A line of more than forty characters that tells more"))),
        F.lit("</td></tr></table></html>"),
    )
    data = F.rtrim(F.translate(F.base64(card.cast("binary")), "+/\r\n", "-_"), F.lit("="))
    address = F.concat(F.lit("Alerts <Alerts@"), F.coalesce("platform", F.lit("spam")), F.lit(".com>"))

    def part(kind: str, body: Column | None = None, parts: Column | None = None) -> Column:
        fields = [F.lit(kind).alias("mimeType")] + ([F.struct(body.alias("data")).alias("body")] if body is not None else []) + ([parts.alias("parts")] if parts is not None else [])
        return F.struct(*fields)

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    inner = part("multipart/alternative", parts=F.array(part("text/html", data)))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(header("FROM", address), header("Subject", F.lit("Jobs"))).alias("headers"), F.array(inner).alias("parts"))
    # one in four came a day earlier as well
    twice = F.explode(F.when(m["id"] % 4 == 0, F.array(F.lit(0), F.lit(86400))).otherwise(F.array(F.lit(0)))).alias("before")
    rows = m.select("*", twice).withColumn("id", F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("-"), F.col("before").cast("string")))
    value = F.to_json(F.struct("id", ((F.col("came") - F.col("before")) * 1000).cast("string").alias("internalDate"), payload.alias("payload")))
    return rows.select(value.alias("value"))


def _received(spark, sf_dir) -> DataFrame:
    senders = [f"alerts@{name}.com" for name in ("linkedin", "indeed", "naukri")]
    return mail.messages(_mails(spark, sf_dir), senders, F.lit("2024-01-01").cast("timestamp"))


@query("alert_messages", with_(m=MAILS) + "SELECT count(*) AS n, count(DISTINCT id) AS mails, CAST(sum(came - b) AS BIGINT) AS received FROM (SELECT *, unnest(CASE WHEN id % 4 = 0 THEN [0, 86400] ELSE [0] END) AS b FROM m) WHERE sender < 3")
def alert_messages(spark, sf_dir):
    rows = _received(spark, sf_dir)
    return rows.agg(F.count("html_body").alias("n"), F.countDistinct(F.split_part("message_id", F.lit("-"), F.lit(1))).alias("mails"), F.sum(F.unix_seconds("received_at")).alias("received"))


@query("alert_lookback", with_(m=MAILS) + "SELECT 'm' || id || '-' || b AS message_id FROM (SELECT *, unnest(CASE WHEN id % 4 = 0 THEN [0, 86400] ELSE [0] END) AS b FROM m) WHERE sender < 3 AND came - b >= 1709287200 + 3000")
def alert_lookback(spark, sf_dir):
    since = F.timestamp_seconds(F.lit(1709287200 + 3000))
    return mail.messages(_mails(spark, sf_dir), [" ALERTS@linkedin.com ", "alerts@indeed.com", "alerts@naukri.com", ""], since).select("message_id")


_LEADS = f"""SELECT {_PLATFORM} AS platform, 'ML Engineer' || CASE kind WHEN 0 THEN ' II' ELSE '' END AS title, company AS company_name, CASE WHEN place < 4 THEN {_PLACE} WHEN kind = 0 THEN NULL END AS location_raw,
CASE place WHEN 0 THEN 'Pune' WHEN 3 THEN 'Zurich' END AS city, place = 1 AS is_remote, CASE kind WHEN 0 THEN 'senior' ELSE 'mid' END AS seniority,
CASE sender WHEN 0 THEN 'https://www.linkedin.com/comm/jobs/view/' || job || '/' WHEN 1 THEN 'https://cts.indeed.com/v3/x?jk=' || lower(hex(job + 1000000000)) ELSE 'https://www.naukri.com/job-listings-dev-at-x-' || job END AS url,
CASE sender WHEN 0 THEN CAST(job AS STRING) WHEN 1 THEN lower(hex(job + 1000000000)) ELSE CAST(job AS STRING) END AS job_key, CASE WHEN sender = 2 AND kind = 2 THEN '4-7' END AS years,
CASE kind WHEN 1 THEN CAST(to_timestamp(came) AT TIME ZONE 'UTC' AS DATE) - 3 END AS posted, 'm' || id || '-0' AS message_id FROM m WHERE sender < 3"""


@query("alert_leads", with_(m=MAILS) + _LEADS)
def alert_leads(spark, sf_dir):
    rows = mail.leads(_received(spark, sf_dir), 9)
    raw = lambda name: F.get_json_object("raw", f"$.{name}")
    return rows.select(
        raw("platform").alias("platform"), "title", "company_name", "location_raw", F.col("location_city").alias("city"), "is_remote", F.col("seniority_guess").alias("seniority"), "url",
        F.coalesce(raw("linkedin_job_id"), raw("indeed_job_key"), raw("naukri_job_id")).alias("job_key"), raw("experience_hint").alias("years"), F.to_date("posted_at").alias("posted"), raw("email_message_id").alias("message_id"),
    )


@query("alert_stubs", with_(m=MAILS) + f"""SELECT 'm' || id || '-0' AS message_id, md5('Discovered via ' || {_PLATFORM} || ' job alert email received ' || strftime(to_timestamp(came) AT TIME ZONE 'UTC', '%Y-%m-%d') || '.' || chr(10) || 'Title: ML Engineer' || CASE kind WHEN 0 THEN ' II' ELSE '' END || chr(10) || 'Company: ' || company || chr(10) || 'Location: ' || coalesce({_PLACE}, 'not stated')
|| CASE kind WHEN 0 THEN chr(10) || 'Snippet: A line of more than forty characters that tells more' ELSE '' END || chr(10) || 'No job description available from this source. Open the posting to read it.') AS text FROM m WHERE sender < 3""")
def alert_stubs(spark, sf_dir):
    rows = mail.leads(_received(spark, sf_dir), 9)
    return rows.select(F.get_json_object("raw", "$.email_message_id").alias("message_id"), F.md5(F.col("description_text").cast("binary")).alias("text"))


@query("alert_misses", with_(m=MAILS) + "SELECT 'm' || id || '-' || b AS message_id FROM (SELECT *, unnest(CASE WHEN id % 4 = 0 THEN [0, 86400] ELSE [0] END) AS b FROM m) WHERE sender = 3")
def alert_misses(spark, sf_dir):
    senders = [f"alerts@{name}.com" for name in ("linkedin", "indeed", "naukri", "spam")]
    return mail.parse_misses(mail.messages(_mails(spark, sf_dir), senders, F.lit("2024-01-01").cast("timestamp"))).select("message_id")


def _mail_folder(spark, sf_dir, parts: int = 1) -> str:
    """Messages as a mailbox lands them: a folder for each sender and day, a file for each of ``parts``."""
    path = f"{shared_folder(spark)}/mailbox-{uuid.uuid4().hex}"
    rows = _mails(spark, sf_dir).filter("get_json_object(value, '$.id') like '%-0'")
    sender = F.lower(F.regexp_extract("value", "<(Alerts@[a-z.]+)>", 1))
    day = F.to_date(F.timestamp_millis(F.get_json_object("value", "$.internalDate").cast("long")))
    rows = rows.select("value", sender.alias("sender"), day.alias("day"), F.pmod(F.hash("value"), F.lit(parts)).alias("_part"))
    for k in range(parts):
        rows.filter(F.col("_part") == k).drop("_part").repartition("sender", "day").write.mode("append").partitionBy("sender", "day").text(path)
    return path


_SENDER = "'alerts@' || CASE sender WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'naukri' ELSE 'spam' END || '.com'"


@query("mail_source", with_(m=MAILS) + f"SELECT {_SENDER} AS sender, 'from:(alerts@indeed.com OR alerts@naukri.com) after:1709290200' AS asked, count(*) AS n, CAST(sum(came) AS BIGINT) AS received FROM m WHERE sender IN (1, 2) AND came >= 1709290200 GROUP BY 1")
def mail_source(spark, sf_dir):
    """A filter on sender and time reaches the reader: it chooses folders and tells what a mailbox would be asked."""
    found = plugin.registered(spark).read.format("millrace_mail").load(_mail_folder(spark, sf_dir))
    wanted = found.filter(F.col("sender").isin("alerts@indeed.com", "alerts@naukri.com") & (F.col("received_at") >= F.timestamp_seconds(F.lit(1709290200))))
    return wanted.groupBy("sender", "asked").agg(F.count("*").alias("n"), F.sum(F.unix_seconds("received_at")).alias("received"))


@query("mail_source_stream", with_(m=MAILS) + f"SELECT 'm' || id || '-0' AS message_id, {_SENDER} AS sender FROM m WHERE sender IN (0, 1) AND came >= 1709290200")
def mail_source_stream(spark, sf_dir):
    """The same source as a stream: every file once, by offsets over what has landed."""
    path = _mail_folder(spark, sf_dir, 2)
    stream = plugin.registered(spark).readStream.format("millrace_mail").options(since="2024-03-01T10:50:00+00:00", senders="alerts@linkedin.com, alerts@indeed.com").load(path)
    return events.drained(stream.select("message_id", "sender"), f"{path}-out", "append")


@query("board_source", "SELECT CAST(substr(source, 4) AS BIGINT) AS source_id, count(*) AS n FROM documents WHERE CAST(substr(source, 4) AS INT) IN (1, 3) GROUP BY 1")
def board_source(spark, sf_dir):
    """Landed pages of boards, read for two sources only."""
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("source_id"), F.lit("greenhouse").alias("adapter"), F.struct("doc_id", "text").alias("job"), F.floor(F.col("doc_id") / 50).alias("number"))
    pages = d.groupBy("source_id", "adapter", "number").agg(F.collect_list("job").alias("jobs"))
    value = F.to_json(F.struct(F.lit(1709287200000).alias("fetched_ms"), F.struct("jobs").alias("page")))
    pages.select("source_id", "adapter", value.alias("value")).repartition("source_id").write.partitionBy("source_id", "adapter").text(path)
    found = plugin.registered(spark).read.format("millrace_board").schema("source_id long, value string").load(path).filter(F.col("source_id").isin(1, 3))
    return found.select("source_id", F.explode(F.from_json("value", "jobs array<struct<doc_id:bigint>>")["jobs"])).groupBy("source_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams


def _ordered_files(spark: SparkSession, sf_dir: str) -> str:
    """Events in three files by time, then a fourth with rows that are late by two weeks."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    for k, rows in enumerate((e.filter(day <= 10), e.filter((day > 10) & (day <= 20)), e.filter(day > 20), e.filter("event_id % 50 = 0").withColumn("ts", F.lit("2024-01-05 12:00:00").cast("timestamp")))):
        rows.coalesce(1).write.parquet(f"{path}/{k}")
    return path


@query("stream_late_rows", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events) GROUP BY 1, 2""")
def stream_late_rows(spark, sf_dir):
    path = _ordered_files(spark, sf_dir)
    stream = events.file_stream(spark, f"{path}/*/*.parquet", spark.read.parquet(f"{path}/0").schema, 1)
    counts = events.windowed_counts(stream, "ts", "event_type", "1 day", "2 days")
    out = events.drained(counts, f"{path}-out", "append")
    return out.select(F.to_date("start").alias("day"), "event_type", F.col("n"))


@query("stream_upsert", "SELECT user_id AS id, max(event_id) AS last FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """Batches upserted into a keyed table, the newest row of each key; buckets with many deltas are merged on the way."""
    path = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("last"))
    e.repartition(3).write.parquet(f"{path}/in")
    stored = keyed.KeyedTable.create(spark, f"{path}/table", e.groupBy("id").agg(F.max("last").alias("last")).schema, ["id"], buckets=8)
    # the newest event is the one with the largest id, in whatever batch it came
    newest = lambda rows: rows.unionByName(stored.read_for(rows)).groupBy("id").agg(F.max("last").alias("last"))
    apply = keyed.upsert_batches(stored, "events", compact_at=1)
    events.upsert_stream(events.file_stream(spark, f"{path}/in/*.parquet", e.schema, 1), lambda rows, batch: apply(newest(rows), batch), f"{path}/checkpoint").awaitTermination()
    return stored.read()


@query("persisted_postings", """SELECT doc_id AS external_id, 1 AS first_day, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS last_day, md5(regexp_replace(coalesce(text, ''), '\r', '', 'g') || CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN ' more' ELSE '' END) AS digest, true AS own_id FROM documents""")
def persisted_postings(spark, sf_dir):
    """Two fetches of a board stored one after the other: the second shows two thirds of the postings, some with another text."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.substring("source", 4, 9).cast("long").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.lit(1).cast("long").alias("company_id"), F.col("lang").alias("title"), F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "").alias("description_text"), F.lit(0).alias("ordinal"), "doc_id")
    again = rows.filter("doc_id % 3 <> 0").withColumn("description_text", F.when(F.col("doc_id") % 5 == 0, F.concat("description_text", F.lit(" more"))).otherwise(F.col("description_text")))
    schema = rows.drop("ordinal", "doc_id").schema
    for name, kind in (("id", "string"), ("content_hash", "string"), ("first_seen_at", "timestamp"), ("last_seen_at", "timestamp"), ("closed_at", "timestamp"), ("missed_runs", "integer")):
        schema = schema.add(name, kind)
    stored = keyed.KeyedTable.create(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", schema, ingest.KEY, {k: v for k, v in ingest.MERGE_RULES.items() if k in schema.fieldNames()}, 8)
    for day, fetched in ((1, rows), (2, again)):
        ingest.persisted(stored, fetched, F.lit(f"2024-03-0{day} 00:00:00").cast("timestamp"), replace(DEFAULT, max_description_chars=100_000_000))
    out = stored.read()
    return out.select(F.col("external_id").cast("long").alias("external_id"), F.day("first_seen_at").alias("first_day"), F.day("last_seen_at").alias("last_day"), F.md5(F.col("description_text").cast("binary")).alias("digest"), (F.col("id") == ingest.posting_id(F.col("source_id"), F.col("external_id"))).alias("own_id"))
