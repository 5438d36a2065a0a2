"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palisade import queries as core

SQL = entry.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = lambda xs: sorted(([plain(v) for v in x] for x in xs), key=str)
    assert rows(got.select(*(f"`{c}`" for c in order)).collect()) == rows([[r[names.index(c)] for c in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).columns == ["val"] and entry.entry(spark).count() > 0


def test_decided_layout(spark, small):
    rows = entry.queries()["decided_layout"](spark, small).collect()
    assert sum(r["size"] for r in rows) == 1500 and len(rows) <= core.BINS
