"""Queries of the dedup engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lamina import catalog

QUICK = [n for n in catalog.queries() if not n.startswith("roundtrip_") or n in ("roundtrip_gdelta", "roundtrip_zdelta_huff", "roundtrip_edit_zstd")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order] and [repr(tuple(r[i] for i in order)) for r in got])


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
