"""Score arithmetic in decimals.  Scores round half to even, prices half up."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.settings import DEFAULT, STATUS_RANKS, TERMINAL_STATUSES, Settings


def decimal(value: Decimal | str | int, precision: int = 10, scale: int = 6) -> Column:
    return F.lit(str(value)).cast(f"decimal({precision},{scale})")


def tier_weight(tier: Column, settings: Settings = DEFAULT) -> Column:
    weights = {"dream": settings.tier_dream, "strong": settings.tier_strong, "volume": settings.tier_volume}
    out = None
    for name, weight in weights.items():
        out = (F if out is None else out).when(tier == name, decimal(weight, 4, 2))
    return out


def recency(age_days: Column, settings: Settings = DEFAULT) -> Column:
    """1 within the grace, then halved each half-life, never below the floor."""
    decayed = F.pow(F.lit(2.0), -(age_days - settings.recency_grace) / F.lit(float(settings.recency_half_life)))
    bounded = F.greatest(decayed, F.lit(float(settings.recency_floor)))
    return F.when(age_days <= settings.recency_grace, decimal(1, 6, 4)).otherwise(F.bround(bounded.cast("decimal(20,18)"), 4).cast("decimal(6,4)"))


def hard_gate(hard: Column, settings: Settings = DEFAULT) -> Column:
    return (
        F.when(hard >= decimal(settings.gate_pass), decimal(1, 4, 2))
        .when(hard >= decimal(settings.gate_warn), decimal(settings.gate_warn_factor, 4, 2))
        .otherwise(decimal(settings.gate_fail_factor, 4, 2))
    )


def blended(hard: Column, nice: Column, settings: Settings = DEFAULT) -> Column:
    share = settings.blend_hard
    mixed = hard.cast("decimal(9,6)") * decimal(share, 4, 2) + nice.cast("decimal(9,6)") * decimal(1 - share, 4, 2)
    return F.bround(mixed, 6).cast("decimal(9,6)")


def composite(hard: Column, nice: Column, tier: Column, age_days: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """(coverage in per cent, composite score of at most 100), two decimals each."""
    base = blended(hard, nice, settings)
    coverage = F.bround(base * F.lit(100), 2).cast("decimal(5,2)")
    factors = (tier_weight(tier, settings) * recency(age_days, settings)).cast("decimal(10,6)") * hard_gate(hard, settings)
    score = (base * F.lit(100)).cast("decimal(12,6)") * factors.cast("decimal(14,8)")
    return coverage, F.bround(F.least(score, decimal(100, 9, 6)), 2).cast("decimal(5,2)")


def call_cost(fresh: Column, cached: Column, written: Column, output: Column, input_usd: Decimal, output_usd: Decimal, inr_per_usd: Decimal, cache_read: Decimal = Decimal("0.10"), cache_write: Decimal = Decimal("1.25")) -> Column:
    """Price of one model call in rupees, rounded half up before anything sums it."""
    weighed = fresh * decimal(input_usd, 9, 4) + cached * decimal(input_usd * cache_read, 12, 6) + written * decimal(input_usd * cache_write, 12, 6) + output * decimal(output_usd, 9, 4)
    return F.round((weighed.cast("decimal(24,6)") * decimal(inr_per_usd, 9, 4)) / F.lit(1_000_000), 2).cast("decimal(18,2)")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a rate; (0, 1) for no trials."""
    p = F.try_divide(successes, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def ratio(found: Column, of: Column) -> Column:
    """A share, 1 where there is nothing to find."""
    return F.coalesce(F.try_divide(found, of), F.lit(1.0))


def status_rank(status: Column) -> Column:
    out = F.when(status == "submitted", 0)
    for name, rank in STATUS_RANKS.items():
        out = out.when(status == name, rank)
    return out.otherwise(-1)


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)
