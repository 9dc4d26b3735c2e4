"""Queries of the training-data operators against SQL, where SQL can."""

import glob
import os

import duckdb
import pytest

from corpusloom.llm import oracles, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows(spark, con, name):
    df = queries.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = con.sql(oracles.oracle_sql()[name])
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want.select(*cols).fetchall())


def test_no_row_twice(spark):
    for name in ("p3_found", "p6_found", "p9_found"):
        df = queries.queries()[name](spark, FOLDER)
        assert df.count() == df.distinct().count(), name
