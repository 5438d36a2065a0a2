"""Which partition a value belongs to."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(pivots: list[int], value) -> int:
    """The first i with value <= pivots[i], or the last partition; a null value goes to the last one."""
    return len(pivots) - 1 if value is None else min(bisect_left(pivots, value), len(pivots) - 1)


def partition_of(value: Column, pivots: list[int]) -> Column:
    """`place` as a column: a balanced tree of comparisons, whatever the number of pivots and the type of the value."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= pivots[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(pivots) - 1)
