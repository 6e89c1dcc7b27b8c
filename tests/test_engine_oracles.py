"""Every query with an oracle returns the rows that DuckDB returns for it."""

import datetime

import duckdb
import pytest

from lumenary import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted((tuple(map(norm, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLES[name])
    assert sorted(d[0] for d in found.description) == columns
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert ordered(df.select(*columns).collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_oracle(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
