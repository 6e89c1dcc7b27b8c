"""Values picked out of JSON whose shape differs from row to row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings_at(raw: Column, *paths: str) -> Column:
    """Strings at the first of the paths that has some: those of an array (scalars as text, others left out), or a scalar by itself.

    Text that is no JSON, and a path that leads nowhere or to an object, give none.
    """
    parsed = F.try_parse_json(raw)

    def at(path: str) -> Column:
        many = F.try_variant_get(parsed, path, "array<variant>")
        one = F.try_variant_get(parsed, path, "variant")
        plain = lambda v: F.when(~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(v, "$", "string"))
        listed = F.array_compact(F.when(many.isNotNull(), F.transform(many, plain)).when(one.isNotNull(), F.array(plain(one))).otherwise(F.array().cast("array<string>")))
        return F.when(F.size(listed) > 0, listed)

    return F.coalesce(*map(at, paths), F.array().cast("array<string>"))
