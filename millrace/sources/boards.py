"""Job boards: landed JSON responses to postings of one shape.

A downloader writes whole responses to a landing folder and renames them when
complete; these scans read that folder.  A file that doesn't parse fails the scan
(FAILFAST) rather than yield half a board.  Nulls count as absence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import epoch_millis, iso_timestamp
from millrace.functions.html import escaped, html_to_text, unescaped
from millrace.functions.location import Gazetteer, parser, remote
from millrace.functions.text import bounded_description, employment_type, seniority, strip, with_computed
from millrace.settings import DEFAULT, Settings

POSTING_COLUMNS = (
    "source_id", "external_id", "url", "title", "description_html", "description_text",
    "department", "location_raw", "location_city", "location_country", "is_remote",
    "employment_type", "seniority_guess", "posted_at", "raw",
)

_NAMED = "struct<id:bigint,name:string,parent_id:bigint>"
GREENHOUSE = (
    "jobs array<struct<id:bigint,absolute_url:string,title:string,content:string,updated_at:string,internal_job_id:bigint,requisition_id:string,"
    f"location:struct<name:string>,departments:array<{_NAMED}>,offices:array<struct<id:bigint,name:string,parent_id:bigint,location:string>>,"
    "metadata:array<struct<name:string,value:variant>>>>"
)
LEVER = (
    "id string, text string, hostedUrl string, applyUrl string, createdAt double, workplaceType string,"
    "categories struct<commitment:string,department:string,team:string,location:string,allLocations:array<string>>,"
    "description string, descriptionPlain string, lists array<struct<text:string,content:string>>, additional string, additionalPlain string"
)
LEVER_ITEM = ",".join(re.sub(r"^(\w+) ", r"\1:", field.strip()) for field in re.split(r",(?![^<]*>)", LEVER))
ASHBY = (
    "apiVersion string, jobs array<struct<id:string,title:string,jobUrl:string,applyUrl:string,department:string,team:string,employmentType:string,location:string,"
    "secondaryLocations:array<struct<location:string,address:variant>>,publishedAt:string,isListed:boolean,isRemote:boolean,descriptionHtml:string,descriptionPlain:string,compensation:variant>>"
)


def _array(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def _first(value: Column) -> Column:
    return F.try_element_at(value, F.lit(1))


def _some(value: Column) -> Column:
    """The value, null if it is empty."""
    return F.nullif(value, F.lit(""))


def _posting(rows: DataFrame, settings: Settings, gazetteer: Gazetteer | None, carried: tuple[str, ...], **columns: Column) -> DataFrame:
    """The shared tail: bounded text, parsed place, rows without text dropped."""
    named = rows.select(*carried, *(value.alias(name) for name, value in columns.items()))
    named = named.filter("description_text <> ''")
    text, cut = bounded_description(F.col("description_text"), settings.max_description_chars)
    named = named.withColumn("_cut", cut).withColumn("description_text", text).withColumn("_place", parser(gazetteer)(F.col("location_raw")))
    named = named.withColumn("location_city", F.col("_place.city")).withColumn("location_country", F.col("_place.country"))
    named = named.withColumn("is_remote", F.col("_remote") | F.col("_place.is_remote")).withColumn("seniority_guess", seniority(F.col("title")))
    flagged = F.when(F.col("_cut"), F.regexp_replace("raw", r"\}$", ',"description_truncated":true}')).otherwise(F.col("raw"))
    return named.withColumn("raw", flagged).select(*POSTING_COLUMNS, *carried)


def deepest_department(departments: Column) -> Column:
    """The first named department with a parent, else the first named one."""
    named = F.filter(departments, lambda d: d["name"] != "")
    return F.coalesce(_first(F.filter(named, lambda d: d["parent_id"].isNotNull()))["name"], _first(named)["name"])


def employment_metadata(metadata: Column) -> Column:
    """The employment type among the metadata, given as text or as a list of it."""
    def text(m: Column) -> Column:
        kind = F.schema_of_variant(m["value"])
        whole = F.when(kind == "STRING", F.try_variant_get(m["value"], "$", "string"))
        return F.coalesce(whole, F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(m["value"], "$[0]", "string")))

    named = F.filter(metadata, lambda m: F.lower(F.trim(m["name"])) == "employment type")
    return _first(F.filter(F.transform(named, text), lambda v: v.isNotNull()))


def greenhouse(spark: SparkSession, path: str, source_id: int, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Postings of landed Greenhouse board responses."""
    return greenhouse_rows(_board(spark, path, GREENHOUSE, source_id), settings, gazetteer)


def _board(spark: SparkSession, path: str, schema: str, source_id: int) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path).select(F.lit(source_id).alias("source_id"), F.explode("jobs").alias("j"))


def greenhouse_rows(jobs: DataFrame, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Postings of (source_id, j) rows."""
    j = F.col("j")
    offices = _array(j["offices"], "array<struct<id:bigint,name:string,parent_id:bigint,location:string>>")
    return _posting(
        jobs, settings, gazetteer, carried,
        source_id=F.col("source_id"), external_id=j["id"].cast("string"), url=j["absolute_url"], title=j["title"],
        description_html=unescaped(_some(j["content"])), description_text=html_to_text(j["content"]),
        department=deepest_department(j["departments"]), location_raw=j["location"]["name"],
        _remote=F.exists(offices, lambda o: F.coalesce(F.contains(F.lower(o["name"]), F.lit("remote")), F.lit(False))),
        employment_type=employment_type(employment_metadata(j["metadata"])), posted_at=iso_timestamp(j["updated_at"]),
        raw=F.to_json(F.struct(j["id"].alias("id"), j["internal_job_id"].alias("internal_job_id"), j["requisition_id"].alias("requisition_id"), j["updated_at"].alias("updated_at"), j["departments"].alias("departments"), offices.alias("offices"), j["metadata"].alias("metadata"))),
    )


def lever_html(p: Column) -> Column:
    """The parts of a Lever posting as one HTML text."""
    lists = _array(p["lists"], "array<struct<text:string,content:string>>")
    blocks = F.transform(lists, lambda b: F.array(F.concat(F.lit("<h3>"), escaped(_some(b["text"])), F.lit("</h3>")), F.concat(F.lit("<ul>"), _some(b["content"]), F.lit("</ul>"))))
    parts = F.array_compact(F.flatten(F.array(F.array(_some(p["description"])), F.flatten(blocks), F.array(_some(p["additional"])))))
    return _some(F.array_join(parts, "\n"))


def lever_text(rows: DataFrame) -> DataFrame:
    """``rows`` with description_text; list blocks keep their order."""
    lists = F.transform(_array(F.col("lists"), "array<struct<text:string,content:string>>"), lambda b: F.struct(strip(F.coalesce(b["text"], F.lit(""))).alias("text"), F.coalesce(b["content"], F.lit("")).alias("content")))
    # Python functions can't run inside higher-order ones: the contents go through in one joined value
    mark = "\x1e"
    joined = html_to_text(F.array_join(F.transform(lists, lambda b: b["content"]), f"\n\n{mark}\n\n"))
    texts = F.transform(F.split(joined, mark), strip)
    sections = F.zip_with(lists, texts, lambda b, t: F.array_join(F.filter(F.array(b["text"], t), lambda x: x != ""), "\n"))
    intro = F.coalesce(_some(F.col("descriptionPlain")), html_to_text(F.col("description")))
    closing = F.coalesce(_some(F.col("additionalPlain")), html_to_text(F.col("additional")))
    parts = F.flatten(F.array(F.array(strip(intro)), sections, F.array(strip(closing))))
    return with_computed(rows, "description_text", strip(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")))


def lever(spark: SparkSession, path: str, source_id: int, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Postings of landed Lever pages; a posting that several pages repeat counts once, as the first page has it."""
    pages = spark.read.schema(LEVER).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return lever_rows(pages.select(F.lit(source_id).alias("source_id"), F.col("_metadata.file_name").alias("name"), F.to_json(F.struct(*pages.columns)).alias("at"), F.struct(*pages.columns).alias("j")), settings, gazetteer)


def lever_rows(items: DataFrame, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Postings of (source_id, name of the page, at, j) rows; of one id the first by name and at stays."""
    first = items.groupBy("source_id", *carried, F.col("j.id").alias("_id")).agg(F.min_by("j", F.struct("name", "at")).alias("j"))
    rows = lever_text(first.select("source_id", *carried, "j.*")).withColumn("_html", lever_html(F.struct("lists", "description", "additional")))
    c = F.col("categories")
    everywhere = _array(c["allLocations"], "array<string>")
    return _posting(
        rows, settings, gazetteer, carried,
        source_id=F.col("source_id"), external_id=F.col("id"), url=F.col("hostedUrl"), title=F.col("text"), description_html=F.col("_html"), description_text=F.col("description_text"),
        department=F.coalesce(_some(c["team"]), c["department"]), location_raw=F.coalesce(_some(c["location"]), _first(everywhere)),
        _remote=F.lower(F.trim(F.coalesce("workplaceType", F.lit("")))) == "remote",
        employment_type=employment_type(c["commitment"]), posted_at=epoch_millis(F.col("createdAt")),
        raw=F.to_json(F.struct("id", "categories", "workplaceType", "createdAt", everywhere.alias("all_locations"))),
    )


def ashby(spark: SparkSession, path: str, source_id: int, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Listed postings of landed Ashby boards."""
    return ashby_rows(_board(spark, path, ASHBY, source_id), settings, gazetteer)


def ashby_rows(jobs: DataFrame, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Listed postings of (source_id, j) rows."""
    j = F.col("j")
    jobs = jobs.filter(F.coalesce(j["isListed"], F.lit(True)))
    others = _array(j["secondaryLocations"], "array<struct<location:string,address:variant>>")
    return _posting(
        jobs, settings, gazetteer, carried,
        source_id=F.col("source_id"), external_id=j["id"], url=j["jobUrl"], title=j["title"], description_html=j["descriptionHtml"],
        description_text=html_to_text(F.coalesce(_some(j["descriptionPlain"]), j["descriptionHtml"])),
        department=F.coalesce(_some(j["team"]), j["department"]), location_raw=j["location"],
        _remote=F.coalesce(j["isRemote"], F.lit(False)) | F.exists(others, lambda o: remote(o["location"])),
        employment_type=employment_type(j["employmentType"]), posted_at=iso_timestamp(j["publishedAt"]),
        raw=F.to_json(F.struct(j["id"].alias("id"), j["department"].alias("department"), j["team"].alias("team"), j["employmentType"].alias("employmentType"), j["isRemote"].alias("isRemote"), others.alias("secondaryLocations"), j["compensation"].alias("compensation"))),
    )


def skipped(spark: SparkSession, path: str, adapter: str) -> DataFrame:
    """reason, n of the rows that a board scan leaves out."""
    if adapter == "lever":
        rows = lever_text(spark.read.schema(LEVER).option("multiLine", True).json(path))
        reason = F.when(F.row_number().over(_same_id()) > 1, "duplicate").when(F.col("description_text") == "", "no_description")
    else:
        jobs = spark.read.schema(GREENHOUSE if adapter == "greenhouse" else ASHBY).option("multiLine", True).json(path).select(F.explode("jobs").alias("j")).select("j.*")
        rows = jobs
        if adapter == "greenhouse":
            reason = F.when(html_to_text(F.col("content")) == "", "no_description")
        else:
            text = html_to_text(F.coalesce(_some(F.col("descriptionPlain")), F.col("descriptionHtml")))
            reason = F.when(~F.coalesce("isListed", F.lit(True)), "unlisted").when(text == "", "no_description")
    return rows.withColumn("reason", reason).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def _same_id():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("hostedUrl")


#: Readers by adapter; ``register`` adds more.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    if name in ADAPTERS and ADAPTERS[name] is not reader:
        raise ValueError(f"{name} is registered already")
    ADAPTERS[name] = reader


def reader_of(name: str) -> Callable[..., DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name]
