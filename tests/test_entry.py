"""The driver's contract, and results against the oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from causegraph import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda df: sorted(tuple("" if v is None or v != v else float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert key(ours) == key(theirs)
