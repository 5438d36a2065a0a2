"""Selection, fetching, arithmetic, aggregates, joins and sorting.

A table is a data frame with a column `pos`, the row's position; positions order the rows. Everything here is lazy, so
a chain of selections and fetches becomes one plan of a scan, a filter and a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.comparators import between, chain

POS = "pos"


def select_range(table: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    """Rows with low <= column < high."""
    return table.filter(between(F.col(column), low, high))


def select_first(table: DataFrame, column: str, value: int) -> DataFrame:
    """At most one row: the first by position whose column has the value."""
    return table.filter(F.col(column) == value).orderBy(POS).limit(1)


def select_where(table: DataFrame, column: str, tests: list[tuple[str | None, int, int]]) -> DataFrame:
    """Rows that a chain of comparisons accepts."""
    return table.filter(chain(F.col(column), tests))


def refine(rows: DataFrame, value: Column, low: int | None, high: int | None) -> DataFrame:
    """Of rows selected before, those whose value is in the range; positions stay aligned."""
    return rows.filter(between(value, low, high))


def positions(rows: DataFrame) -> DataFrame:
    return rows.select(POS)


def fetch(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column at the selected positions."""
    return rows.select(POS, F.col(column).alias("val"))


def fetch_at(table: DataFrame, at: DataFrame, column: str) -> DataFrame:
    """Values of a column at positions that come from elsewhere (another version, or a stored result)."""
    return table.join(at.select(POS), POS).select(POS, F.col(column).alias("val"))


def add(left: Column, right: Column) -> Column:
    """Sum of two values, widened so that it can't overflow 32 bits."""
    return left.cast("long") + right.cast("long")


def subtract(left: Column, right: Column) -> Column:
    return left.cast("long") - right.cast("long")


AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "sum": lambda c: F.sum(c.cast("long")),
    "avg": F.avg,
    "count": lambda c: F.count(F.lit(1)),
}


def aggregate(rows: DataFrame, kind: str, value: Column) -> DataFrame:
    """One row with one column `val`."""
    return rows.agg(AGGREGATES[kind](value).alias("val"))


def hash_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Inner equi-join; the optimizer picks broadcast, hash or merge by the measured sizes."""
    return left.join(right, on)


def sort_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(column)


def printed(rows: DataFrame, *values: Column, by: str = POS) -> DataFrame:
    """Values in the order of positions, or of another column."""
    named = [v.alias("val" if len(values) == 1 else f"val{i}") for i, v in enumerate(values)]
    return rows.orderBy(by).select(*named)


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, cnt) of equally wide bins from 1; values outside go to 0 and bins + 1."""
    return rows.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("cnt"))
