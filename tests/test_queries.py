"""Every catalogue query with SQL gives the same rows as DuckDB; the others run and have rows."""

import glob
import math
import os

import duckdb
import pytest

from codeloom.queries import catalogue

QUERIES, SQL = catalogue()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    def one(x):
        return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
