"""Operators that SQL can express return the rows that DuckDB returns."""

import duckdb
import pytest

from lumenary.llm import queries

TABLES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)
