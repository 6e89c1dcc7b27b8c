"""Values that an expression works out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once a row, so that neither the expression nor its cost grows with each mention of it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))
