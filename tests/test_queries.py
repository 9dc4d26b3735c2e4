"""Every query of the engine against SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from corpusloom import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return None if math.isnan(f) else round(f, 9)
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= registry.queries().keys()
    assert set(registry.oracle_sql()) <= set(registry.queries())
