"""Waiting times of a downloader in front of the landing zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_wait(attempt: Column, base_s: float = 1.0, most_s: float = 30.0) -> Column:
    """Upper bound of the wait before a retry; it doubles with each attempt from 0."""
    return F.least(F.lit(most_s), F.lit(base_s) * F.pow(F.lit(2.0), attempt))


def jittered_wait(attempt: Column, retry_after_s: Column, seed: int, base_s: float = 1.0, most_s: float = 30.0) -> Column:
    """A wait drawn evenly below the bound, or what the server asked for."""
    return F.coalesce(F.when(retry_after_s.isNotNull(), F.least(retry_after_s, F.lit(most_s))), F.rand(seed) * longest_wait(attempt, base_s, most_s))


def retry_after_s(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date."""
    text = F.trim(header)
    # the weekday says nothing that the date doesn't
    date = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_seconds(date) - F.unix_seconds(now)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    asked = F.coalesce(number, wait.cast("double"))
    return F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0)))
