"""Every registered query of the reads library against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from readloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.select(*names).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
