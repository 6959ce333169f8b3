"""Seed files, in YAML or JSON, to checked DataFrames.

Files are read by Spark, wherever it can read; YAML becomes JSON in the task that
read it, and everything behind is columns.  What must not be is looked for with
joins and counts; the driver hears of the first few offenders.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.variants import CONTENT
from millrace.operators.vocabulary import Vocabulary


class SeedError(ValueError):
    """A seed file that must not be loaded."""


@F.pandas_udf(T.StringType())
def _as_json(texts: pd.Series) -> pd.Series:
    import yaml

    return texts.map(lambda text: json.dumps(yaml.safe_load(text) or {}, default=str), na_action="ignore")


def documents(spark: SparkSession, path: str | Path, suffixes: tuple[str, ...] = ("json", "yaml", "yml")) -> DataFrame:
    """file, folder, value (JSON) of the files at or below a path."""
    rows = spark.read.option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").text(str(path), wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("place"), "value")
    value = F.when(F.endswith("place", F.lit(".json")), F.col("value")).otherwise(_as_json(F.when(~F.endswith("place", F.lit(".json")), F.col("value"))))
    decoded = F.url_decode(F.replace("place", F.lit("+"), F.lit("%2B")))
    return rows.select(F.regexp_extract(decoded, "([^/]+)$", 1).alias("file"), F.regexp_extract(decoded, "^(.*)/[^/]+$", 1).alias("folder"), value.alias("value"))


def document(spark: SparkSession, path: str | Path) -> Mapping:
    """One small file of settings as a mapping, on the driver."""
    return json.loads(documents(spark, path).first()["value"])


def _refuse(rows: DataFrame, name: Column, what: str) -> None:
    found = sorted(str(row[0]) for row in rows.select(name).limit(20).collect())
    if found:
        raise SeedError(f"{what}: {found}")


def _unique(rows: DataFrame, name: str, what: str) -> DataFrame:
    _refuse(rows.groupBy(name).count().filter("count > 1"), F.col(name), f"{what} given twice")
    return rows


def load_vocabulary(spark: SparkSession, path: str | Path, adjacency: str | Path | None = None) -> Vocabulary:
    credits = document(spark, adjacency).get("families") if adjacency else {}
    return Vocabulary.from_mapping(document(spark, path), {k: float(v) for k, v in (credits or {}).items()})


_COMPANY = "companies array<struct<slug:string,name:string,tier:string,status:string,tags:array<string>,location_filter:array<string>,sources:array<struct<adapter:string,config:map<string,string>>>>>"


def load_companies(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(companies, sources) of a company seed; slugs are unique."""
    entries = documents(spark, path).select(F.posexplode(F.from_json("value", _COMPANY)["companies"]).alias("at", "e"))
    nothing = F.array().cast("array<string>")
    rows = entries.select((F.col("at") + 1).cast("long").alias("id"), "e.slug", "e.name", F.coalesce(F.nullif("e.tier", F.lit("")), F.lit("volume")).alias("tier"), F.coalesce(F.nullif("e.status", F.lit("")), F.lit("tracking")).alias("status"), F.coalesce("e.tags", nothing).alias("tags"), F.coalesce("e.location_filter", nothing).alias("location_filter"))
    sources = entries.select((F.col("at") + 1).cast("long").alias("company_id"), F.explode("e.sources").alias("s")).select("company_id", "s.adapter", "s.config")
    return _unique(rows, "slug", "slugs"), sources


def load_variants(spark: SparkSession, folder: str | Path) -> DataFrame:
    """key, content of the JSON files of a folder."""
    return documents(spark, folder, ("json",)).select(F.regexp_extract("file", r"^(.*)\.json$", 1).alias("key"), F.from_json("value", CONTENT).alias("content"))


def load_claims(spark: SparkSession, path: str | Path) -> DataFrame:
    """key, statement, verdict of approved claims; placeholders are refused."""
    entries = documents(spark, path).select(F.inline(F.from_json("value", "claims array<struct<key:string,statement:string,verdict:string>>")["claims"]))
    entries = _unique(entries.withColumn("statement", F.coalesce("statement", F.lit(""))), "key", "claims")
    approved = entries.filter(F.lower("verdict").isin("yes", "true"))
    _refuse(approved.filter(F.col("statement").rlike("TODO|TBD|XX")), F.col("key"), "approved claims with placeholders")
    return approved.select("key", "statement", F.lit("yes").alias("verdict"))


def load_tags(spark: SparkSession, path: str | Path) -> DataFrame:
    """bullet_id, skills, claims, text."""
    tags = F.from_json("value", "bullets map<string,struct<skills:array<string>,claims:array<string>,text:string>>")["bullets"]
    nothing = F.array().cast("array<string>")
    return documents(spark, path).select(F.explode(tags).alias("bullet_id", "t")).select("bullet_id", F.coalesce("t.skills", nothing).alias("skills"), F.coalesce("t.claims", nothing).alias("claims"), "t.text")


def load_cases(spark: SparkSession, folder: str | Path) -> DataFrame:
    """id, slice, text, labels of golden cases: a YAML file and a text beside it each; a case without its text is refused."""
    cases = documents(spark, folder, ("yaml",)).select("file", F.from_json("value", "id string, slice string, jd_text_file string").alias("c"), F.coalesce(F.get_json_object("value", "$.labels"), F.lit("{}")).alias("labels"))
    cases = _unique(cases.select("c.id", "c.slice", F.coalesce("c.jd_text_file", F.regexp_replace("file", r"\.yaml$", ".txt")).alias("text_file"), "labels"), "id", "cases")
    texts = spark.read.option("pathGlobFilter", "*.txt").text(str(folder), wholetext=True)
    texts = texts.select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("text_file"), F.col("value").alias("text"))
    _refuse(cases.join(texts, "text_file", "left_anti"), F.col("id"), "cases without a text")
    return cases.join(texts, "text_file").select("id", "slice", "text", "labels")
