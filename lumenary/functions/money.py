"""Pay, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary.dims import CURRENCIES


def half_up(x: Column) -> Column:
    """The nearest whole number; halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def midpoint(low: Column, high: Column) -> Column:
    """Middle of two bounds, or the one there is; zero counts as missing."""
    low, high = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    return F.coalesce(half_up((low + high) / 2), low, high)


def parse_pay(text: Column) -> Column:
    """Middle of the least and largest number in a text, in thousands if the text has a ``k``."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("double"))
    mid = half_up((F.array_min(numbers) + F.array_max(numbers)) / 2)
    return F.when(F.lower(text).contains("k"), mid * 1000).otherwise(mid)


def normalize_pay(amount: Column, currency: Column) -> tuple[Column, Column]:
    """(amount, currency): no amount for null or zero, whose currency stays; else an unknown currency is USD."""
    none = amount.isNull() | (amount == 0)
    known = F.when(F.upper(currency).isin(*CURRENCIES), F.upper(currency)).otherwise("USD")
    return F.when(~none, amount), F.when(none, F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD"))).otherwise(known)


def percentile_in(amount: Column, low: Column, high: Column) -> Column:
    """Where an amount is between two bounds, from 0 to 100; 50 without a range."""
    at = half_up((amount - low) / F.nullif((high - low).cast("double"), F.lit(0.0)) * 100)
    return F.when(high > low, F.least(F.lit(100), F.greatest(F.lit(0), at))).otherwise(F.lit(50)).cast("long")
