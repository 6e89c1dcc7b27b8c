"""Keyset pagination: the predicate, a page, and the cursor's codec."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST_LIMIT = 50, 100


def clamp_limit(limit) -> int:
    """A page size: 50 if it is not a whole number above 0, 100 at most."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        return DEFAULT_LIMIT
    return min(limit, MOST_LIMIT)


def encode_cursor(key, row_id) -> str:
    """A cursor as URL-safe text."""
    return base64.urlsafe_b64encode(json.dumps({"k": key, "id": row_id}, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple | None:
    """(key, id) of a cursor; None for none and for text that is not a cursor."""
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return (got["k"], got["id"])
    except (TypeError, ValueError, KeyError):
        return None


def beyond(key: str, row_id: str, last_key, last_id, descending: bool) -> Column:
    """Rows after the cursor: nulls come first in ascending and last in descending order, ties go by id."""
    k, i = F.col(key), F.col(row_id)
    after_id = i < F.lit(last_id) if descending else i > F.lit(last_id)
    if last_key is None:
        return (k.isNull() & after_id) if descending else (k.isNotNull() | after_id)
    at = F.lit(last_key)
    same = (k == at) & after_id
    return F.coalesce((k < at) | same, F.lit(True)) if descending else F.coalesce((k > at) | same, F.lit(False))


def page(rows: DataFrame, key: str, row_id: str, limit: int, cursor: tuple | None = None, descending: bool = True) -> DataFrame:
    """``limit`` rows after the cursor, and one more that tells whether there is a next page.

    A top-k of the whole table: Spark keeps ``limit`` + 1 rows a task, never a full sort.
    """
    if cursor is not None:
        rows = rows.where(beyond(key, row_id, *cursor, descending))
    order = [F.col(key).desc_nulls_last(), F.col(row_id).desc()] if descending else [F.col(key).asc_nulls_first(), F.col(row_id).asc()]
    return rows.orderBy(*order).limit(clamp_limit(limit) + 1)
