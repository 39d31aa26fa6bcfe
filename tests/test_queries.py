"""Every registered query beside its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_query_has_sql():
    assert set(entry._QUERIES) <= set(SQL)
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_query_matches_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
