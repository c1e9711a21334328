"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    mine = catalogue.queries()[name](spark, SF)
    theirs = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=str)
    want = sorted((tuple(plain(r[theirs.columns.index(c)]) for c in columns) for r in theirs.fetchall()), key=str)
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)
