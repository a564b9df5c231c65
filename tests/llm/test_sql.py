"""Every query of the subpackage that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from waymark.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
