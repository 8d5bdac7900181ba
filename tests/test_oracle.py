"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = tables.execute(SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in columns]
    assert len(order) == len(cur.description)
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row["photos"], row["groups"], row["duplicates"], row["unique"]) == (200, 12, 13, 187)
