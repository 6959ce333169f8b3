"""Coverage of requirements by variants, composite scores, ranking, gaps.

Variants are few (``MOST_VARIANTS`` is checked) and so is the vocabulary: levels
are worked out per token and variant, and that table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scores import composite, decimal
from millrace.functions.text import numeric
from millrace.settings import DEFAULT, HARD_KINDS, NICE_KINDS, Settings

SCORED_KINDS = (*HARD_KINDS, *NICE_KINDS)
MOST_LEVELS = 500_000
MOST_VARIANTS = 10_000


def best_bullets(bullet_rows: DataFrame) -> DataFrame:
    """variant_id, token, bullet_id, text, claim_keys: the bullet that shows a skill best.

    Most claim keys first, then the earlier position.
    """
    rows = bullet_rows.select("variant_id", "position", "bullet_id", "text", "claim_keys", F.explode(F.array_distinct("skills")).alias("token"))
    best = F.min_by(F.struct("bullet_id", "text", "claim_keys"), F.struct((-F.size("claim_keys")).alias("n"), F.col("position")))
    return rows.groupBy("variant_id", "token").agg(best.alias("b")).select("variant_id", "token", "b.bullet_id", "b.text", "b.claim_keys")


def _shown(bullet: Column) -> Column:
    """Level that a held skill reaches: a bullet must show it, and numbers need claims."""
    return F.when(bullet.isNull(), F.lit("partial")).when(numeric(bullet["text"]) & (F.size(bullet["claim_keys"]) == 0), F.lit("partial")).otherwise(F.lit("met"))


def _note(bullet: Column) -> Column:
    return F.when(bullet.isNull(), F.lit("Listed as a skill; no bullet demonstrates it.")).when(numeric(bullet["text"]) & (F.size(bullet["claim_keys"]) == 0), F.lit("Bullet is quantified but carries no claim keys."))


def variant_ids(variants: DataFrame) -> list:
    """The ids of the variants, which are few; refuses more than ``MOST_VARIANTS``."""
    found = [row[0] for row in variants.select("variant_id").distinct().limit(MOST_VARIANTS + 1).collect()]
    if len(found) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    return sorted(found)


def _for_each(rows: DataFrame, ids: list, kind) -> DataFrame:
    """Every row once for each variant."""
    return rows.withColumn("variant_id", F.explode(F.array(*map(F.lit, ids)).cast(f"array<{kind.simpleString()}>")))


def level_table(variants: DataFrame, bullet_rows: DataFrame, skills: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """variant_id, token, level, note, evidence for each token and variant.

    A requirement's level depends on its token alone, so levels are worked out
    once for the vocabulary, not once for each requirement.
    """
    ids, kind = variant_ids(variants), variants.schema["variant_id"].dataType
    empty = F.array().cast("array<string>")
    held_by = variants.select("variant_id", F.explode("skill_set").alias("token")).distinct()
    tokens = skills.select("token").union(held_by.select("token")).distinct()
    families = skills.groupBy("family").agg(F.array_sort(F.collect_list("token")).alias("siblings"))
    known = skills.join(families, "family").select("token", "members", "credit", "siblings")
    labels = skills.select(F.col("token").alias("near"), F.col("label").alias("near_label"))
    pairs = _for_each(tokens, ids, kind).join(known, "token", "left").join(variants.select("variant_id", "skill_set"), "variant_id")

    token = F.col("token")
    members = F.coalesce("members", empty)
    several = F.size(members) > 0
    hits = F.array_sort(F.array_intersect(members, "skill_set"))
    whole = F.size(hits) == F.size(members)
    held = F.array_contains("skill_set", token)
    siblings = F.array_except(F.array_intersect(F.coalesce("siblings", empty), "skill_set"), F.array(token))
    enough = (F.coalesce("credit", F.lit(0.0)) > 0) & (F.col("credit") >= F.lit(float(settings.adjacency_min)))
    pairs = pairs.withColumn("hits", hits).withColumn("near", F.when(enough, F.array_min(siblings))).withColumn("shown_by", F.when(several, F.try_element_at(hits, F.lit(1))).when(held, token))
    best = best_bullets(bullet_rows).select("variant_id", F.col("token").alias("shown_by"), F.struct("bullet_id", "text", "claim_keys").alias("bullet"))
    pairs = pairs.join(best, ["variant_id", "shown_by"], "left").join(labels, "near", "left")
    bullet, hits = F.col("bullet"), F.col("hits")
    whole = F.size(hits) == F.size(members)
    some = F.size(hits) > 0
    level = (
        F.when(several & whole, _shown(bullet)).when(several & some, F.lit("partial")).when(several, F.lit("missing"))
        .when(held, _shown(bullet)).when(F.col("near").isNotNull(), F.lit("partial")).otherwise(F.lit("missing"))
    )
    covers = F.concat(F.lit("Covers "), F.array_join(hits, ", "), F.lit("; no evidence for "), F.array_join(F.array_sort(F.array_except(members, hits)), ", "), F.lit("."))
    note = (
        F.when(several & whole, _note(bullet)).when(several & some, covers)
        .when(several, F.concat(F.lit("No evidence for any of "), F.array_join(F.array_sort(members), ", "), F.lit(".")))
        .when(held, _note(bullet)).when(F.col("near").isNotNull(), F.concat(F.lit("Adjacent evidence: "), F.col("near_label"), F.lit(".")))
    )
    return pairs.select("variant_id", "token", level.alias("level"), note.alias("note"), F.when(level == "met", bullet).alias("evidence"))


def levels(requirements: DataFrame, variants: DataFrame, bullet_rows: DataFrame, skills: DataFrame, settings: Settings = DEFAULT, together: bool = False) -> DataFrame:
    """One row per scored requirement and variant: level, note, evidence.

    ``requirements``: posting_id, requirement_id, kind, text, normalised_skill,
    weight, ordinal.  ``variants``: variant_id, skill_set.  ``skills``: token,
    label, family, members, credit.  The requirements aren't shuffled while the
    table of levels, the vocabulary times the variants, has at most ``MOST_LEVELS``
    rows; a larger one is joined by token.  For what is grouped by posting next, the
    requirements are brought ``together`` by posting while they are narrow and few, so that
    the rows for each variant needn't be shuffled.
    """
    known = level_table(variants, bullet_rows, skills, settings).select(F.col("variant_id").alias("k_variant"), F.col("token").alias("k_token"), "level", "note", "evidence")
    ids = variant_ids(variants)
    few = len(ids) * skills.count() <= MOST_LEVELS
    scored = requirements.filter(F.col("kind").isin(*SCORED_KINDS))
    rows = _for_each(scored.repartition("posting_id") if few and together else scored, ids, variants.schema["variant_id"].dataType)
    small = F.broadcast(known) if few else known
    joined = rows.join(small, (rows["normalised_skill"] == F.col("k_token")) & (rows["variant_id"] == F.col("k_variant")), "left")
    unresolved = F.when(F.col("normalised_skill").isNull(), F.lit("Requirement did not resolve to a vocabulary token."))
    return joined.select("posting_id", "variant_id", "requirement_id", "kind", "text", "weight", "ordinal", F.coalesce("level", F.lit("missing")).alias("level"), F.coalesce("note", unresolved).alias("note"), "evidence")


def credit(level: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(level == "met", decimal(1, 3, 2)).when(level == "partial", decimal(settings.partial_credit, 3, 2)).otherwise(decimal(0, 3, 2))


def bucket_coverage(earned: Column, total: Column) -> Column:
    """Share of a bucket's weight, six decimals; an empty bucket is covered."""
    share = F.bround(F.try_divide(earned.cast("decimal(16,4)"), total.cast("decimal(16,4)")), 6).cast("decimal(9,6)")
    return F.coalesce(share, decimal(1, 9, 6))


def coverage(level_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """posting_id, variant_id, hard and nice coverage, met and total counts, hard_missing."""
    hard, nice = F.col("kind").isin(*HARD_KINDS), F.col("kind").isin(*NICE_KINDS)
    weight = F.col("weight").cast("decimal(5,2)")
    earned = weight * credit(F.col("level"), settings)
    met = F.col("level") == "met"
    sums = level_rows.groupBy("posting_id", "variant_id").agg(
        F.sum(F.when(hard, earned)).alias("_he"), F.sum(F.when(hard, weight)).alias("_ht"),
        F.sum(F.when(nice, earned)).alias("_ne"), F.sum(F.when(nice, weight)).alias("_nt"),
        F.count_if(hard & met).alias("hard_met"), F.count_if(hard).alias("hard_total"),
        F.count_if(nice & met).alias("nice_met"), F.count_if(nice).alias("nice_total"),
        F.count_if(hard & (F.col("level") == "missing")).alias("hard_missing"),
    )
    return sums.withColumn("hard_coverage", bucket_coverage(F.col("_he"), F.col("_ht"))).withColumn("nice_coverage", bucket_coverage(F.col("_ne"), F.col("_nt"))).drop("_he", "_ht", "_ne", "_nt")


def scores(covered: DataFrame, postings: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Coverage rows with coverage_pct and composite_score.

    ``postings``: posting_id, tier (null: volume), age_days.  Postings without a
    hard requirement aren't scored.
    """
    rows = covered.filter("hard_total > 0").join(postings.select("posting_id", F.coalesce("tier", F.lit("volume")).alias("tier"), "age_days"), "posting_id")
    pct, score = composite(F.col("hard_coverage"), F.col("nice_coverage"), F.col("tier"), F.col("age_days"), settings)
    return rows.withColumn("coverage_pct", pct).withColumn("composite_score", score)


def recommended(scored: DataFrame, settings: Settings = DEFAULT, default_variant: str | None = None) -> DataFrame:
    """``scored`` with is_recommended, one row per posting.

    Within the tie band of the leader: higher hard coverage, fewer hard gaps, the
    default variant, the smaller id.
    """
    posting = Window.partitionBy("posting_id")
    near = F.max("composite_score").over(posting) - F.col("composite_score") <= decimal(settings.tie_band, 5, 2)
    other = ~F.col("variant_id").eqNullSafe(F.col(default_variant)) if default_variant else F.lit(True)
    place = F.row_number().over(posting.orderBy(F.desc("_near"), F.desc("hard_coverage"), "hard_missing", "_other", "variant_id"))
    return scored.withColumn("_near", near).withColumn("_other", other).withColumn("is_recommended", place == 1).drop("_near", "_other")


def gaps(level_rows: DataFrame) -> DataFrame:
    """posting_id, variant_id, gaps: what isn't met, hard and missing first, by ordinal."""
    rows = level_rows.filter((F.col("level") != "met") & F.col("kind").isin(*SCORED_KINDS))
    entry = F.struct(
        F.when(F.col("kind").isin(*HARD_KINDS), 0).otherwise(1).alias("a"), F.when(F.col("level") == "missing", 0).otherwise(1).alias("b"), F.col("ordinal"),
        F.struct("requirement_id", "kind", "level", "text", "note").alias("gap"),
    )
    return rows.groupBy("posting_id", "variant_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["gap"]).alias("gaps"))


def evidence(level_rows: DataFrame) -> DataFrame:
    """posting_id, variant_id, evidence: what is met, with the bullet that shows it."""
    rows = level_rows.filter("level = 'met' and evidence is not null")
    entry = F.struct("ordinal", F.struct("requirement_id", F.col("text").alias("requirement"), "level", F.col("evidence.bullet_id").alias("bullet_ref"), F.col("evidence.text").alias("bullet"), F.col("evidence.claim_keys").alias("claim_keys")).alias("e"))
    return rows.groupBy("posting_id", "variant_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("evidence"))


def blocking(gap_list: Column) -> Column:
    return F.filter(gap_list, lambda g: (g["kind"] == "hard") & (g["level"] == "missing"))


def gap_report(gap_rows: DataFrame, width: int = 70) -> DataFrame:
    """kind, text, n of missing requirements over the given rows."""
    rows = gap_rows.select(F.explode("gaps").alias("g")).filter("g.level = 'missing'")
    return rows.groupBy(F.col("g.kind").alias("kind"), F.left("g.text", F.lit(width)).alias("text")).agg(F.count("*").alias("n"))


def top(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(most)
