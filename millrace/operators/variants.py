"""Structured profile variants: bullets, skill sets, tags."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.vocabulary import Vocabulary, phrase_key

_BULLET = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("claim_keys", T.ArrayType(T.StringType()))])
_BULLETS = T.ArrayType(_BULLET)

#: The content of a variant.
CONTENT = T.StructType([
    T.StructField("experience", T.ArrayType(T.StructType([T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("bullets", _BULLETS)])))]))),
    T.StructField("projects", T.ArrayType(T.StructType([T.StructField("bullets", _BULLETS)]))),
    T.StructField("skills", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))]))),
])


def _some(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def all_bullets(content: Column) -> Column:
    """Bullets of experience, then of projects, in order."""
    kind = _BULLETS.simpleString()
    blocks = F.flatten(F.transform(_some(content["experience"], CONTENT["experience"].dataType.simpleString()), lambda e: _some(e["blocks"], f"array<struct<bullets:{kind}>>")))
    of_work = F.flatten(F.transform(blocks, lambda b: _some(b["bullets"], kind)))
    of_projects = F.flatten(F.transform(_some(content["projects"], f"array<struct<bullets:{kind}>>"), lambda p: _some(p["bullets"], kind)))
    return F.concat(of_work, of_projects)


def bullets(variants: DataFrame, variant: str = "id", content: str = "content") -> DataFrame:
    """variant_id, position, bullet_id, text, skills, claim_keys; one row per bullet."""
    rows = variants.select(F.col(variant).alias("variant_id"), F.posexplode(all_bullets(F.col(content))).alias("position", "b"))
    empty = F.array().cast("array<string>")
    return rows.select("variant_id", "position", F.coalesce("b.id", F.lit("")).alias("bullet_id"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.skills", empty).alias("skills"), F.coalesce("b.claim_keys", empty).alias("claim_keys"))


def split_item(item: str) -> Iterator[str]:
    """An item of a skills line, its parts outside brackets, and the parts within brackets that close.

    A bracket pair at the outermost level is left out itself; a closing bracket
    too many, and what comes at its level, is outside.
    """
    yield item
    depths = list(itertools.accumulate((char in "([{") - (char in ")]}") for char in item))
    opens = [char in "([{" and depth == 1 for char, depth in zip(item, depths)]
    closes = [char in ")]}" and depth == 0 for char, depth in zip(item, depths)]
    outside = "".join(char for char, depth, closing in zip(item, depths, closes) if depth <= 0 and not closing)
    yield from (part.strip() for part in re.split("[/&;,]", outside) if part)
    group = list(itertools.accumulate(closes))
    for number in range(sum(closes)):
        inside = "".join(char for char, depth, opening, at in zip(item, depths, opens, group) if depth > 0 and not opening and at == number)
        yield from (part.strip() for part in re.split("[,/;&]", inside) if part.strip())


_VERSION = re.compile(r"\s+v?\d+(\.\d+)*$", re.IGNORECASE)


def item_tokens(item: str, vocabulary: Vocabulary) -> set[str]:
    """Tokens that an item names; a version number at a part's end may be left out."""
    found = set()
    for part in split_item(item):
        for form in (part, _VERSION.sub("", part).strip()):
            token = vocabulary.aliases.get(phrase_key(form))
            if token:
                found.add(token)
                break
    return found


def skills_lines(variants: DataFrame, vocabulary: Vocabulary, variant: str = "id", content: str = "content") -> DataFrame:
    """variant_id, item, tokens: every item of the skills lines, resolved."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def resolve(items: pd.Series) -> pd.Series:
        return items.map(lambda i: sorted(item_tokens(i, vocabulary)) if isinstance(i, str) else [])

    groups = variants.select(F.col(variant).alias("variant_id"), F.explode(f"{content}.skills").alias("g"))
    items = groups.select("variant_id", F.explode("g.items").alias("item"))
    return items.withColumn("tokens", resolve(F.col("item")))


def skill_sets(variants: DataFrame, vocabulary: Vocabulary, variant: str = "id", content: str = "content") -> DataFrame:
    """variant_id, declared, proven, skill_set (their union), unproven; sorted arrays."""
    declared = skills_lines(variants, vocabulary, variant, content).groupBy("variant_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("declared"))
    proven = bullets(variants, variant, content).groupBy("variant_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("skills")))).alias("proven"))
    every = variants.select(F.col(variant).alias("variant_id")).join(declared, "variant_id", "left").join(proven, "variant_id", "left")
    empty = F.array().cast("array<string>")
    every = every.withColumn("declared", F.coalesce("declared", empty)).withColumn("proven", F.coalesce("proven", empty))
    return every.withColumn("skill_set", F.array_sort(F.array_union("declared", "proven"))).withColumn("unproven", F.array_sort(F.array_except("declared", "proven")))


def unresolved_items(variants: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return skills_lines(variants, vocabulary).filter(F.size("tokens") == 0).select("variant_id", "item").distinct()


def untagged_bullets(variants: DataFrame) -> DataFrame:
    return bullets(variants).filter(F.size("skills") == 0).select("variant_id", "bullet_id")


def tag_problems(variants: DataFrame, skills: DataFrame, approved_claims: DataFrame) -> DataFrame:
    """(variant_id, bullet_id, problem, value) of unknown tokens and claims that aren't approved."""
    rows = bullets(variants)
    tokens = rows.select("variant_id", "bullet_id", F.explode("skills").alias("value")).join(skills.select(F.col("token").alias("value")), "value", "left_anti")
    claims = rows.select("variant_id", "bullet_id", F.explode("claim_keys").alias("value")).join(approved_claims.select(F.col("key").alias("value")), "value", "left_anti")
    columns = ("variant_id", "bullet_id", "problem", "value")
    return tokens.withColumn("problem", F.lit("unknown skill")).select(*columns).unionByName(claims.withColumn("problem", F.lit("claim not approved")).select(*columns))


def tag_file_problems(tags: DataFrame, variants: DataFrame, prefix_chars: int = 40) -> DataFrame:
    """Tags of unknown bullets, and tags whose quoted text no longer starts the bullet's."""
    known = bullets(variants).select(F.col("bullet_id").alias("k_id"), F.col("text").alias("k_text"))
    rows = tags.join(known, tags["bullet_id"] == known["k_id"], "left")
    moved = F.col("text").isNotNull() & ~F.startswith("k_text", F.left("text", F.lit(prefix_chars)))
    problem = F.when(F.col("k_id").isNull(), F.lit("unknown bullet")).when(moved, F.lit("text changed"))
    return rows.withColumn("problem", problem).filter("problem is not null").select("bullet_id", "problem").distinct()


def with_tags(variants: DataFrame, tags: DataFrame, content: str = "content") -> DataFrame:
    """Variants whose bullets carry the tags of their id; bullets without tags stay.

    ``tags`` (bullet_id, skills, claims) is the size of a tag file and becomes one map.
    """
    table = tags.agg(F.map_from_entries(F.collect_list(F.struct("bullet_id", F.struct("skills", "claims")))).alias("tag_map"))

    def tagged(b: Column) -> Column:
        tag = F.try_element_at(F.col("tag_map"), b["id"])
        return F.struct(b["id"].alias("id"), b["text"].alias("text"), F.coalesce(tag["skills"], b["skills"]).alias("skills"), F.coalesce(tag["claims"], b["claim_keys"]).alias("claim_keys"))

    def block(x: Column) -> Column:
        return F.struct(F.transform(x["bullets"], tagged).alias("bullets"))

    new = F.struct(
        F.transform(f"{content}.experience", lambda e: F.struct(F.transform(e["blocks"], block).alias("blocks"))).alias("experience"),
        F.transform(f"{content}.projects", block).alias("projects"),
        F.col(f"{content}.skills").alias("skills"),
    )
    return variants.join(F.broadcast(table)).withColumn(content, new).drop("tag_map")


def approved_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.lower("verdict") == "yes").select("key").distinct()
