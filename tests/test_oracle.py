"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from cartloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["k", "itemset", "count", "support"] and rows.count() == 41
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
