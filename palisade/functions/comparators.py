"""Predicates over one value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a comparison.
LESS, GREATER, EQUAL = 1, 2, 4


def compare(value: Column, mask: int, bound: int) -> Column:
    """value compared with a bound; the mask adds up LESS, GREATER and EQUAL."""
    tests = {LESS: value < bound, GREATER: value > bound, EQUAL: value == bound, LESS | EQUAL: value <= bound, GREATER | EQUAL: value >= bound, LESS | GREATER: value != bound}
    if mask in (0, LESS | GREATER | EQUAL):
        return F.lit(bool(mask))
    return tests[mask]


def chain(value: Column, tests: list[tuple[str | None, int, int]]) -> Column:
    """Tests (link, mask, bound) folded from the left; the first link is not used, the others are "and" or "or"."""
    joined = {"and": lambda a, b: a & b, "or": lambda a, b: a | b}
    first, *rest = tests
    return reduce(lambda out, t: joined[t[0]](out, compare(value, *t[1:])), rest, compare(value, *first[1:]))


def between(value: Column, low: int | None, high: int | None) -> Column:
    """low <= value < high; a missing bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    return out if high is None else out & (value < high)
