"""Queries on orders with more rows than a sort draws its bounds from, in several files, out of order and with gaps between keys."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palisade import queries as core

ROWS = 40_000
#: Else so few rows are put in one partition.
SMALL = {f"spark.sql.adaptive.{k}": v for k, v in {"advisoryPartitionSizeInBytes": "96k", "coalescePartitions.minPartitionSize": "96k", "coalescePartitions.parallelismFirst": "false"}.items()}


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("larger"))
    rows = spark.range(ROWS).select((F.col("id") * 3 + F.when(F.col("id") > 900, 10**6).otherwise(-500)).alias("o_orderkey"), (F.col("id") * 7 % 1500).alias("o_custkey"), F.lit(1.5).alias("o_totalprice"))
    rows.repartition(3, F.xxhash64("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield folder
    for k, v in before.items():
        spark.conf.set(k, v)


def differences(spark, folder, name):
    """(rows, rows that only the query has, rows that only its SQL has)."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got, want = entry.queries()[name](spark, folder).select(*names).collect(), want.fetchall()
    assert len(set(want)) == len(want)
    return len(got), sorted({*map(tuple, got)} - {*want})[:5], sorted({*want} - {*map(tuple, got)})[:5]


@pytest.mark.parametrize("name, rows", [("binary_load", ROWS), ("csv_load", ROWS), ("reopened_catalog", 2), ("csv_statistics", 1)])
def test_positions(spark, larger, name, rows):
    assert differences(spark, larger, name) == (rows, [], [])


def test_work_on_values_that_are_there(spark, tmp_path):
    """Updates and deletes meet the first row by position, so not an inserted one where the table has its value before."""
    rows = [(i, v, 1.5) for i, v in enumerate([*range(1, 41), *range(50_000, 50_090), *range(60_000, 60_090)] * 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    at, price, last = {p: v for p, v, _ in rows}, {p: x for p, _, x in rows}, len(rows) - 1
    for line in core._LINES_OF_WORK:
        one, two = (*map(int, re.findall(r"\d+", line)), None)[:2]
        if line[0] == "i":
            last += 1
            at[last], price[last] = one, float(two)
        elif line[0] in "ud" and (found := min((p for p, v in at.items() if v == one), default=None)) is not None:
            if line[0] == "u":
                at[found] = two
            else:
                del at[found]
    got = core.QUERIES["exec_work_rows"](spark, str(tmp_path)).select("pos", "o_custkey", "o_totalprice")
    assert sorted(map(tuple, got.collect())) == [(p, v, price[p]) for p, v in sorted(at.items())]
