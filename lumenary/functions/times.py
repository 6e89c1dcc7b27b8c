"""Durations as people configure them, and the freshness that a source's configuration asks for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of freshness of a source that says nothing.
FRESH_DAYS = 14
_UNITS = {"m": 60_000, "h": 3_600_000}


def duration_ms(text: str | None, default: int) -> int:
    """Milliseconds of "30m", "6h" or a plain number; ``default`` for anything else."""
    text = (text or "").strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return int(float(text))
    found = re.fullmatch(r"(\d+)\s*([mh])", text)
    return int(found[1]) * _UNITS[found[2]] if found else default


def fresh_since(mode: Column, fast_hours: Column, deep_days: Column, window_days: Column, as_of: Column) -> Column:
    """The moment from which postings count as fresh: by the mode's own setting, else the source's window, else 14 days."""
    days = F.coalesce(window_days, F.lit(FRESH_DAYS)) * 24
    hours = F.when((mode == "FAST") & fast_hours.isNotNull(), fast_hours).when((mode == "DEEP") & deep_days.isNotNull(), deep_days * 24).otherwise(days)
    return F.timestamp_add("HOUR", -hours.cast("int"), as_of)


def json_list(text: Column, kind: str = "array<string>") -> Column:
    """An array written as JSON; empty for null or anything that is no such array."""
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))
