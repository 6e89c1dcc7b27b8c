"""Small helpers for functions that Spark calls with Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: What a Python worker keeps for its next tasks; a step that needs the memory clears it.
KEPT: dict = {}


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null text is an empty one."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column as str; a null text is an empty one."""
    return [t or "" for t in column.to_pylist()]


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[pa.Array], list]) -> DataFrame:
    """``df`` with columns that ``make`` computes from one column, batch by batch.

    ``make`` gets the Arrow array of ``column`` and returns a list or array for each field. Spark bounds
    a batch by rows and by bytes, so memory follows the batch and the longest single text only.
    A column of ``df`` with the name of a new one is replaced.
    """
    new = {f.name for f in fields}
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(batch.schema.get_field_index(column)))
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new]
            made = [pa.array(v, type=arrow.field(f.name).type) for f, v in zip(fields, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, *made], schema=arrow)

    return df.mapInArrow(run, schema)
