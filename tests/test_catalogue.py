"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in columns]) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert not set(entry.oracle_sql()) - set(entry.queries())
