"""Scalar functions over token counts and money, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Bytes of a cached chunk by provider kind, and the least prefix that may be marked for caching.
CHUNKS = {"large": 1024, "small": 64, "medium": 128, "huge": 32768}
CACHE_MINIMUM = 1024


def saved_share(saved: Column, raw: Column, digits: int = 1) -> Column:
    """Percent saved; null where there was nothing to save from."""
    return F.round(100.0 * saved / F.nullif(raw, F.lit(0)), digits)


def saved_share_or_zero(saved: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round(100.0 * saved / raw)).otherwise(F.lit(0.0))


def remaining_share(part: Column, raw: Column, digits: int = 1) -> Column:
    return F.round((1 - part / F.nullif(raw, F.lit(0))) * 100, digits)


def cost(tokens: Column, per_million: Column) -> Column:
    """Decimal money for tokens at a price for a million."""
    return (tokens.cast("decimal(18,0)") * per_million.cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(38,6)")


def padding(tokens: Column, chunk: Column) -> Column:
    """Tokens that are missing to a whole number of chunks."""
    return F.pmod(-tokens, chunk)


def cached_part(tokens: Column, chunk: Column) -> Column:
    return tokens - F.pmod(tokens, chunk)


def may_cache(tokens: Column) -> Column:
    return tokens >= CACHE_MINIMUM


def monthly(per_day: Column) -> Column:
    return F.round(per_day * 30, 1)


def days_left(budget: Column, per_day: Column) -> Column:
    return F.round(budget / F.nullif(per_day, F.lit(0.0))).cast("bigint")


def over_threshold(share: Column, least: float = 60.0) -> Column:
    """Class of a share: "high" strictly above the threshold, else "normal"."""
    return F.when(share > least, "high").otherwise("normal")


def budget_band(days: Column) -> Column:
    return F.when(days >= 30, "safe").when(days >= 20, "watch").when(days.isNotNull(), "short")


def lookup(mapping: dict[str, str | float], key: Column, default: str | float) -> Column:
    """A fixed map's value, or the default for other keys."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def exact_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """Sum of doubles that doesn't depend on the order of rows: those of up to ten decimals are added up as decimals, the nearest double is the result.

    Values of more decimals, beyond the range of decimal(28,10), infinite or not a number are added as doubles; nulls add nothing, and without values the sum is null.
    """
    decimal = value.try_cast("decimal(28,10)")
    short = decimal.cast("double").eqNullSafe(value)
    of = lambda part: F.sum(part) if window is None else F.sum(part).over(window)
    exact, rest = of(F.when(short, decimal)).cast("double"), of(F.when(~short, value))
    return F.coalesce(exact + rest, exact, rest)
