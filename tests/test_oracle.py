"""Every query with SQL against DuckDB, over whole tables."""

import glob
import os
import sys

import duckdb
import pytest
from wordloom.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert names == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(got) == len(expected)
    assert got == expected


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(NAMES)


def test_entry_without_llm():
    """The entry points hold without the subpackage."""
    import __spark_entry__ as entry

    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())
    assert "search_ranked" in NAMES
    assert sys.modules["wordloom.plans.catalogue"]
