"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os
from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry_point
from vellum.plans import all as plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = os.path.join(SF_DIR, name)
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def _rows(frame):
    def plain(v):
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return None if pd.isna(v) else round(float(v), 6)
        return None if v is None or v is pd.NaT or (not isinstance(v, str) and pd.isna(v)) else str(v)

    names = sorted(frame.columns)
    return names, Counter(tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = plans.QUERIES[name](spark, SF_DIR).toPandas()
    want = tables.execute(plans.ORACLE_SQL[name]).fetchdf()
    assert _rows(got) == _rows(want)


def test_entry_and_names(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert plans.QUERIES["recursive_chunks"](spark, SF_DIR).count() > 0
