"""Each registered query with SQL against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

from chunkloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    expected = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    at = [expected.columns.index(c) for c in df.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
