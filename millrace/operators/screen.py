"""Screening: an ordered chain of predicates, of which the first rejection counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import experience_years, first_word_found, strip, words_found
from millrace.settings import DEFAULT, Settings

SUPERSEDED = "superseded_by:"
SHOWN_MARKERS = 4

#: A predicate gives the reason for a rejection, null to let a posting pass.
Predicate = Callable[[Settings], Column]


def company_blacklisted(settings: Settings) -> Column:
    return F.when(F.col("company_status") == "blacklisted", F.lit("company_blacklisted"))


def superseded(settings: Settings) -> Column:
    return F.when(F.col("filtered_out") & F.startswith(F.coalesce("filter_reason", F.lit("")), F.lit(SUPERSEDED)), F.lit("superseded"))


def closed(settings: Settings) -> Column:
    return F.when(F.col("closed_at").isNotNull(), F.lit("closed"))


def unusable_description(settings: Settings) -> Column:
    short = F.length(strip(F.coalesce("description_text", F.lit("")))) < settings.min_description_chars
    stub = F.lit(False) if settings.extract_alerts else F.coalesce("needs_description", F.lit(False))
    return F.when(stub, F.lit("no_description")).when(short, F.lit("description_too_short"))


def seniority_denied(settings: Settings) -> Column:
    guess = F.lower(strip(F.coalesce(F.nullif("seniority_guess", F.lit("")), F.lit("unknown"))))
    return F.when(guess.isin([s.lower() for s in settings.seniority_deny]), F.concat(F.lit("seniority:"), guess))


def location_matches(token: Column) -> Column:
    """Whether a posting is where a filter token says: remote, a country or a city."""
    wanted = F.lower(F.trim(token))
    place = (F.lower(F.trim(F.coalesce("location_country", F.lit("")))) == wanted) | (F.lower(F.trim(F.coalesce("location_city", F.lit("")))) == wanted)
    return F.when(wanted == "", F.lit(False)).when(wanted == "remote", F.col("is_remote")).otherwise(place)


def location_denied(settings: Settings) -> Column:
    """Vetoes ("!token") first, then any positive token; unknown places pass."""
    default = F.array(*map(F.lit, settings.default_locations)).cast("array<string>")
    own = F.coalesce("location_filter", F.array().cast("array<string>"))
    tokens = F.when(F.size(own) > 0, own).otherwise(default)
    vetoes = F.filter(F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit("!"))), lambda t: F.substring(t, 2, 1_000)), location_matches)
    wanted = F.filter(tokens, lambda t: ~F.startswith(t, F.lit("!")))
    unknown = F.col("location_city").isNull() & F.col("location_country").isNull() & ~F.col("is_remote")
    return (
        F.when(F.size(vetoes) > 0, F.concat(F.lit("location_excluded:"), F.lower(F.try_element_at(vetoes, F.lit(1)))))
        .when((F.size(wanted) == 0) | unknown | F.exists(wanted, location_matches), F.lit(None).cast("string"))
        .otherwise(F.lit("location"))
    )


def title_denied(settings: Settings) -> Column:
    word = first_word_found(F.col("title"), settings.title_deny)
    return F.when(word.isNotNull(), F.concat(F.lit("title_keyword:"), word))


def role_markers(settings: Settings = DEFAULT) -> Column:
    return words_found(F.coalesce("description_text", F.lit("")), settings.role_markers)


def role_denied(settings: Settings) -> Column:
    if settings.role_marker_min <= 0:
        return F.lit(None).cast("string")
    hits = F.col("role_markers")
    more = F.size(hits) - SHOWN_MARKERS
    reason = F.concat(F.lit("role_domain:"), F.array_join(F.slice(hits, 1, SHOWN_MARKERS), "+"), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return F.when(F.size(hits) >= settings.role_marker_min, reason)


def experience_denied(settings: Settings) -> Column:
    if settings.max_years <= 0:
        return F.lit(None).cast("string")
    years = F.col("required_years")
    return F.when(years > settings.max_years, F.concat(F.lit("experience:"), years.cast("string"), F.lit("y")))


def _text_if(open_: Column) -> Column:
    return F.when(open_, F.coalesce("description_text", F.lit("")))


#: Columns that a predicate reads besides a posting's own, computed for the rows that
#: no earlier predicate rejects.
PREPARED: dict[Predicate, tuple[str, Callable[[Settings, Column], Column]]] = {
    role_denied: ("role_markers", lambda settings, open_: words_found(_text_if(open_), settings.role_markers)),
    experience_denied: ("required_years", lambda settings, open_: experience_years(_text_if(open_))),
}

CHAIN: tuple[tuple[str, Predicate], ...] = (
    ("company_status", company_blacklisted),
    ("superseded", superseded),
    ("closed", closed),
    ("no_description", unusable_description),
    ("seniority", seniority_denied),
    ("location", location_denied),
    ("title_denylist", title_denied),
    ("role_domain", role_denied),
    ("experience", experience_denied),
)


def verdicts(postings: DataFrame, settings: Settings = DEFAULT, chain: Sequence[tuple[str, Predicate]] = CHAIN) -> DataFrame:
    """``postings`` with ``reason``: the first rejection, null for a pass.

    COALESCE stops at the first reason.  What is costly to know (markers in the
    text, years of experience) is prepared for the rows that are still open.  What
    is prepared and the reason pass through generators, so that nothing that
    refers to them is merged with them or pushed below, and each is evaluated once.
    """

    def once(value: Column) -> Column:
        return F.explode(F.array(value))

    rows, waiting = postings.withColumn("reason", F.lit(None).cast("string")), []
    for _, predicate in chain:
        if predicate in PREPARED:
            name, prepare = PREPARED[predicate]
            rows = rows.withColumn("reason", once(F.coalesce("reason", *waiting)))
            rows, waiting = rows.withColumn(name, once(prepare(settings, F.col("reason").isNull()))), []
        waiting.append(predicate(settings))
    return rows.withColumn("reason", once(F.coalesce("reason", *waiting)))


def with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with their company's status and location filter."""
    side = companies.select(F.col("id").alias("c_id"), F.col("status").alias("company_status"), "location_filter")
    return postings.join(side, postings["company_id"] == side["c_id"]).drop("c_id")


def screen_delta(judged: DataFrame) -> DataFrame:
    """id, filtered_out, filter_reason of the rows whose stored flags change.

    Superseded rows belong to the collapse and are left alone.
    """
    out = F.col("reason").isNotNull()
    same = F.when(out, F.col("filtered_out") & F.col("filter_reason").eqNullSafe(F.col("reason"))).otherwise(~F.col("filtered_out"))
    return judged.filter(~F.col("reason").eqNullSafe(F.lit("superseded")) & ~same).select("id", out.alias("filtered_out"), F.col("reason").alias("filter_reason"))


def screen_counts(judged: DataFrame) -> DataFrame:
    """One row: what a screen considered, passed, rejected and changed."""
    out = F.col("reason").isNotNull()
    skipped = F.col("reason").eqNullSafe(F.lit("superseded"))
    return judged.agg(
        F.count("*").alias("considered"),
        F.count_if(~out).alias("passing"),
        F.count_if(out).alias("rejected"),
        F.count_if(out & ~skipped & ~F.col("filtered_out")).alias("newly_rejected"),
        F.count_if(~out & F.col("filtered_out")).alias("readmitted"),
        F.count_if(skipped).alias("skipped_superseded"),
    )


def family(reason: Column) -> Column:
    return F.split_part(reason, F.lit(":"), F.lit(1))


def reason_counts(reasons: DataFrame, column: str = "reason") -> DataFrame:
    """n by reason family; rows without a reason are left out."""
    return reasons.filter(F.col(column).isNotNull()).groupBy(family(F.col(column)).alias("family")).agg(F.count("*").alias("n"))


def apply_delta(postings: DataFrame, delta: DataFrame) -> DataFrame:
    """Postings with the flags of a screen or collapse delta written."""
    new = delta.select(F.col("id").alias("d_id"), F.col("filtered_out").alias("d_out"), F.col("filter_reason").alias("d_reason"))
    hit = F.col("d_id").isNotNull()
    joined = postings.join(new, postings["id"] == new["d_id"], "left")
    return joined.withColumn("filtered_out", F.when(hit, F.col("d_out")).otherwise(F.col("filtered_out"))).withColumn("filter_reason", F.when(hit, F.col("d_reason")).otherwise(F.col("filter_reason"))).drop("d_id", "d_out", "d_reason")


def scoreable(postings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Open, visible postings that have requirements."""
    return postings.filter(F.col("closed_at").isNull() & ~F.col("filtered_out")).join(requirements.select(F.col("posting_id").alias("id")), "id", "left_semi")


def pending_extraction(postings: DataFrame, requirements: DataFrame, version: str | None, limit: int | None = None) -> DataFrame:
    """Open, visible postings without requirements of a version, newest first.

    A null version asks for all of them again.
    """
    visible = postings.filter(F.col("closed_at").isNull() & ~F.col("filtered_out"))
    if version is not None:
        done = requirements.filter(F.col("prompt_version") == version).select(F.col("posting_id").alias("id"))
        visible = visible.join(done, "id", "left_anti")
    visible = visible.orderBy(F.desc("first_seen_at"), "id")
    return visible if limit is None else visible.limit(limit)
