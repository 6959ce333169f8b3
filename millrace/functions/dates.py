"""Dates as boards and mails write them; everything is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 2000, 2100


def plausible(moment: Column) -> Column:
    return F.when(F.year(moment).between(FIRST_YEAR, LAST_YEAR), moment)


def iso_timestamp(value: Column) -> Column:
    """ISO 8601 with or without offset or time; without an offset it is UTC."""
    text = F.trim(value)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}(\.\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$")
    return plausible(F.when(shaped, F.try_to_timestamp(F.regexp_replace(text, "z$", "Z"))))


def epoch_millis(value: Column) -> Column:
    millis = value.try_cast("double")
    inside = millis.between(0, 4.2e12)
    return plausible(F.timestamp_millis(F.when(inside, millis).cast("long")))


def date_only(value: Column) -> Column:
    text = F.left(F.trim(value), F.lit(10))
    return plausible(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text).cast("timestamp")))


def relative_day(phrase: Column, anchor: Column) -> Column:
    """Midnight of the day that "posted n days ago" means; null for "30+ days"."""
    midnight = F.date_trunc("day", anchor)
    days = F.regexp_extract(phrase, r"(?i)\bposted\s+(\d+)\s*days?\s+ago\b", 1)
    return (
        F.when(phrase.rlike(r"(?i)\bposted\s+\d+\+\s*days?\s+ago\b"), F.lit(None).cast("timestamp"))
        .when(phrase.rlike(r"(?i)\bposted\s+today\b"), midnight)
        .when(phrase.rlike(r"(?i)\bposted\s+yesterday\b"), F.dateadd(midnight, F.lit(-1)).cast("timestamp"))
        .when(days != "", F.dateadd(midnight, -F.nullif(days, F.lit("")).cast("int")).cast("timestamp"))
    )


def posted_at(value: Column, anchor: Column) -> Column:
    """A date of unknown shape."""
    text = F.trim(value.cast("string"))
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), date_only(text))
        .when(text.rlike(r"^\d{10,16}$"), epoch_millis(text))
        .when(F.contains(F.lower(text), F.lit("posted")), relative_day(text, anchor))
        .otherwise(iso_timestamp(text))
    )


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole spans of 24 hours, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000))


def local_time(moment: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.from_utc_timestamp(moment, zone)
