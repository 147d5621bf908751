"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.derived import TABLES
from check import _rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    if name not in entry.oracle_sql():  # held against a brute-force version in a test of its own
        assert df.count() > 0
        return
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
