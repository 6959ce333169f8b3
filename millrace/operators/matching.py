"""Names that mean the same company: trigram similarity without a cross join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import company_key
from millrace.session import shared_folder

UNMATCHED = "unmatched"


def trigrams(name: Column) -> Column:
    """Different trigrams of the words of a name, each with two spaces before and one after."""
    apart = F.concat(F.lit("  "), F.regexp_replace(F.lower(name), r"(?U)[^\p{Alnum}]+", "   "), F.lit(" "))
    # what looks ahead takes nothing, so the next one may begin within it
    return F.array_distinct(F.regexp_extract_all(apart, F.lit(r"(?U)(?=(  \p{Alnum}| \p{Alnum}[\p{Alnum} ]|\p{Alnum}{2}[\p{Alnum} ]))"), F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two names."""
    shared = F.size(F.array_intersect(trigrams(a), trigrams(b)))
    return F.coalesce(F.try_divide(shared, F.size(trigrams(a)) + F.size(trigrams(b)) - shared), F.lit(0.0))


def similar_names(left: DataFrame, right: DataFrame, threshold: float, left_name: str = "name", right_name: str = "name") -> DataFrame:
    """(left_name, right_name, similarity) of pairs at or above a positive threshold.

    Prefix filtering: with trigrams in one global order, rarest first, two sets of
    similarity t must share one among the first ``n - ceil(t * n) + 1`` of each.
    So an equi join over those few, rare trigrams finds every pair; the sets
    themselves verify it.
    """
    a = left.select(F.col(left_name).alias("a_name")).filter("a_name is not null").distinct().withColumn("a_set", trigrams(F.col("a_name")))
    b = right.select(F.col(right_name).alias("b_name")).filter("b_name is not null").distinct().withColumn("b_set", trigrams(F.col("b_name")))
    grams = a.select(F.explode("a_set").alias("gram")).unionAll(b.select(F.explode("b_set").alias("gram")))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, name: str, own: str) -> DataFrame:
        listed = side.select(name, F.explode(own).alias("gram")).join(frequency, "gram")
        ordered = listed.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("o"))
        keep = F.size("o") - F.ceil(F.size("o") * F.lit(threshold) - 1e-9) + 1
        return ordered.select(name, F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("e")).select(name, F.col("e.gram").alias("gram"))

    pairs = prefix(a, "a_name", "a_set").join(prefix(b, "b_name", "b_set"), "gram").select("a_name", "b_name").distinct()
    sets = pairs.join(a, "a_name").join(b, "b_name")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    scored = sets.withColumn("similarity", shared / (F.size("a_set") + F.size("b_set") - shared))
    return scored.filter(F.col("similarity") >= threshold).select("a_name", "b_name", "similarity")


def best_company(names: DataFrame, companies: DataFrame, threshold: float = 0.45, name: str = "name") -> DataFrame:
    """name, company_id, similarity: the most similar company, ties to the smaller id.

    Deleted companies and the reserved one are never matched.
    Names with a company's very trigrams have similarity one, which nothing beats, so an
    equi join on the sets settles them; only the others are compared.  What is settled is
    written once: filters of what follows would else work out sets ahead of the distinct.
    """
    usable = companies.filter(F.col("deleted_at").isNull() & (F.col("slug") != UNMATCHED))
    wanted = names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("_set", F.array_sort(trigrams(F.col("name"))))
    owners = usable.select(F.col("id").alias("company_id"), F.array_sort(trigrams(F.col("name"))).alias("_set")).filter(F.size("_set") > 0).groupBy("_set").agg(F.min("company_id").alias("company_id"))
    path = f"{shared_folder(names.sparkSession)}/settled-{uuid.uuid4().hex}"
    wanted.join(owners, "_set", "left").select("name", "company_id").write.parquet(path)
    settled = names.sparkSession.read.parquet(path)
    equal = settled.filter("company_id is not null").select("name", "company_id", F.lit(1.0).alias("similarity"))
    pairs = similar_names(settled.filter("company_id is null"), usable, threshold)
    owned = pairs.join(usable.select(F.col("id").alias("company_id"), F.col("name").alias("b_name")), "b_name")
    order = Window.partitionBy("a_name").orderBy(F.desc("similarity"), "company_id")
    return equal.unionByName(owned.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(F.col("a_name").alias("name"), "company_id", "similarity"))


def suggestions(candidate: str, companies: DataFrame, most: int = 5, threshold: float = 0.3) -> DataFrame:
    """The companies whose names are most similar to one name."""
    score = similarity(F.col("name"), F.lit(candidate))
    return companies.filter("deleted_at is null").withColumn("similarity", score).filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(most)


def lead_names(leads: DataFrame) -> DataFrame:
    """(name, external_ids): leads grouped by normalised employer, blank ones dropped."""
    keyed = leads.withColumn("name", company_key(F.col("company_name"))).filter("name <> ''")
    return keyed.groupBy("name").agg(F.array_sort(F.collect_list("external_id")).alias("external_ids"))


def resolved_leads(leads: DataFrame, companies: DataFrame, threshold: float = 0.45) -> DataFrame:
    """external_id, company_id: the matched company or the reserved one.

    Each different name is matched once.
    """
    keyed = leads.select("company_name").filter("company_name is not null").distinct().select("company_name", company_key(F.col("company_name")).alias("name")).filter("name <> ''")
    best = best_company(keyed.select("name"), companies, threshold)
    matched = keyed.join(best, "name").select("company_name", F.col("company_id").alias("matched"))
    reserved = companies.filter(F.col("slug") == UNMATCHED).agg(F.min("id").alias("reserved_id"))
    joined = leads.join(matched, "company_name", "left")
    return joined.join(F.broadcast(reserved)).select("external_id", F.coalesce("matched", "reserved_id").alias("company_id"))


def with_reserved_company(companies: DataFrame) -> DataFrame:
    """Companies with the reserved row for unmatched leads, added where it is missing."""
    spark = companies.sparkSession
    row = spark.range(1).select(F.lit(UNMATCHED).alias("slug"))
    missing = row.join(companies.select("slug"), "slug", "left_anti")
    next_id = companies.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    filled = {"slug": F.col("slug"), "name": F.lit("Unmatched (mail alerts)"), "tier": F.lit("volume"), "status": F.lit("tracking"), "id": F.col("id")}
    new = missing.join(F.broadcast(next_id)).select(*(filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in companies.schema))
    return companies.unionByName(new)
