"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows_of(columns, rows):
    turn = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in turn) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


def test_sql_names_are_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
