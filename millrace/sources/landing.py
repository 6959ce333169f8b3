"""Landed runs of boards: each source by itself, each run wholly or not at all.

A downloader writes the pages of a run to ``source_id=.../run=...`` and, last of
all, a ``manifest.json`` that says which adapter and files there are, how long they
are, and how the run ended.  A run without a manifest is not over.  A run whose
files are absent or of another length, or have a page that doesn't parse as its
adapter's response, has a status and no rows; all other runs go on.  Nothing is
thrown for what one source did wrong.

A file is a page, or, where the manifest says ``by_line``, as many as it has lines:
a board of many pages lands as few files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.location import Gazetteer
from millrace.functions.text import bound, with_computed
from millrace.settings import DEFAULT, SEEN_STATUSES, Settings
from millrace.sources import boards

MANIFEST = "manifest.json"
_FILES = "*.{json,txt}"
_MANIFEST = "adapter string, status string, files array<struct<name:string,bytes:bigint>>, by_line boolean"
_RUN = ("source_id", "run")
#: What a page holds, by adapter; a bare list of postings is wrapped, so that a bad one shows.
PAGES = {"greenhouse": boards.GREENHOUSE, "ashby": boards.ASHBY, "lever": f"items array<struct<{boards.LEVER_ITEM}>>"}


def _placed(rows: DataFrame, file: str, *columns: Column | str) -> DataFrame:
    place = lambda part: F.regexp_extract(file, "/source_id=([0-9]+)/run=([^/]+)/(.+)$", part)
    return rows.select(place(1).try_cast("long").alias("source_id"), place(2).alias("run"), place(3).alias("name"), *columns).filter("source_id is not null")


def files(spark: SparkSession, path: str) -> DataFrame:
    """source_id, run, name (below the run), bytes of all landed files, none of which is opened."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", _FILES).option("recursiveFileLookup", True).load(path)
    return _placed(rows, "path", F.col("length").alias("bytes"))


def _contents(spark: SparkSession, path: str, names: str) -> DataFrame:
    """source_id, run, name, value of the landed files of some names."""
    rows = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).text(path, wholetext=True)
    return _placed(rows, "_metadata.file_path", "value")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """source_id, run and what the manifest of each run says."""
    return _contents(spark, path, MANIFEST).filter(F.col("name") == MANIFEST).select(*_RUN, F.from_json("value", _MANIFEST).alias("m")).select(*_RUN, "m.*")


def pages(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """source_id, run, name, number (within the file), adapter, value of the pages of the runs of a manifest."""
    # a row for each run goes to the files, not the files to the runs
    kinds = F.broadcast(manifest.select(*_RUN, "adapter", "by_line"))
    held = _contents(spark, path, _FILES).filter(F.col("name") != MANIFEST).join(kinds, list(_RUN))
    lines = F.when(F.col("by_line"), F.filter(F.split("value", "\n"), lambda line: line != "")).otherwise(F.array("value"))
    return held.select(*_RUN, "name", "adapter", F.posexplode(lines).alias("number", "value"))


def parsed_page(value: Column, adapter: str) -> Column:
    """The page as a struct of its adapter's response, with its text in ``_wrong`` where it is none."""
    text = F.concat(F.lit('{"items":'), value, F.lit("}")) if adapter == "lever" else value
    return F.from_json(text, f"{PAGES[adapter]}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})


def _items(page: Column, adapter: str) -> Column:
    return page["items"] if adapter == "lever" else page["jobs"]


def _reads(value: Column, adapter: str) -> Column:
    """Whether a page has its postings, each with an id."""
    return bound(parsed_page(value, adapter), lambda page: page["_wrong"].isNull() & F.coalesce(F.forall(_items(page, adapter), lambda item: item["id"].isNotNull()), F.lit(False)))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """source_id, run, adapter, status, detail: how each landed run ended.

    The detail names files, the first in order of name.
    """
    manifest, here = manifests(spark, path), files(spark, path)
    everyone = here.select(*_RUN).distinct()
    listed = manifest.select(*_RUN, F.explode("files").alias("f")).select(*_RUN, F.col("f.name").alias("name"), F.col("f.bytes").alias("told"))
    reads = F.lit(None).cast("boolean")
    for adapter in PAGES:
        reads = F.when(F.col("adapter") == adapter, _reads(F.col("value"), adapter)).otherwise(reads)
    # pages are judged where they are read; only the names of bad files go on
    bad = with_computed(pages(spark, path, manifest), "reads", F.coalesce(reads, F.lit(False))).filter("not reads").select(*_RUN, "name").distinct().withColumn("bad", F.lit(True))
    both = listed.join(here, [*_RUN, "name"], "left").join(bad, [*_RUN, "name"], "left")
    broken = F.when(F.col("bytes").isNull(), "absent").when(F.col("told") != F.col("bytes"), "of another length").when(F.col("bad"), "doesn't parse")
    faults = both.withColumn("fault", broken).filter("fault is not null").groupBy(*_RUN).agg(F.min(F.struct("name", "fault")).alias("first"), F.bool_or(F.col("fault") != "doesn't parse").alias("short"))
    known = everyone.join(manifest, list(_RUN), "left").join(faults, list(_RUN), "left")
    ended = F.when(F.col("status").isNull() | F.col("adapter").isNull(), "incomplete").when(~F.col("adapter").isin(*PAGES), "schema_error").when(~F.col("status").isin(*SEEN_STATUSES), F.col("status"))
    status = F.coalesce(ended, F.when(F.col("short"), "incomplete").when(F.col("first").isNotNull(), "schema_error"), F.col("status"))
    detail = F.when(F.col("status").isNull(), "no manifest").when(~F.col("adapter").isin(*PAGES), F.concat(F.lit("no adapter "), "adapter")).when(ended.isNull() & F.col("first").isNotNull(), F.concat("first.name", F.lit(" "), "first.fault"))
    return known.select(*_RUN, "adapter", status.alias("status"), detail.alias("detail"))


def postings(spark: SparkSession, path: str, settings: Settings = DEFAULT, gazetteer: Gazetteer | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings of all runs that ended well, with their run, and how every run ended."""
    ended = runs(spark, path)
    good = ended.filter(F.col("status").isin(*SEEN_STATUSES)).select(*_RUN)
    manifest = manifests(spark, path)
    # files are read once for each adapter that there is
    present = {row[0] for row in manifest.filter(F.col("adapter").isin(*PAGES)).select("adapter").distinct().collect()}
    held = pages(spark, path, manifest).join(F.broadcast(good), list(_RUN))
    parts = []
    for adapter, project in (("greenhouse", boards.greenhouse_rows), ("lever", boards.lever_rows), ("ashby", boards.ashby_rows)):
        if adapter not in (present or {"lever"}):
            continue
        own = with_computed(held.filter(F.col("adapter") == adapter).select(*_RUN, "name", "number", "value"), "page", parsed_page(F.col("value"), adapter))
        items = own.select(*_RUN, "name", "number", F.posexplode(_items(F.col("page"), adapter)).alias("i", "j")).select(*_RUN, "name", F.struct("number", "i").alias("at"), "j")
        parts.append(project(items, settings, gazetteer, ("run",)))
    return reduce(DataFrame.unionByName, parts), ended
