"""Changes: each gives a new version of a table and leaves the old one as it is."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from palisade.operators.relational import POS, select_first


def last_position(table: DataFrame) -> int:
    found = table.agg(F.max(POS)).first()[0]
    return -1 if found is None else found


def first_position(table: DataFrame, column: str, value: int) -> int | None:
    found = select_first(table, column, value).select(POS).first()
    return found and found[0]


def insert(table: DataFrame, rows: list[tuple], last: int | None = None) -> DataFrame:
    """table with rows appended; each has a value for every column but pos, and may have more, which are ignored. New
    positions follow the largest one (`last`, where it is known). That one is looked up at once, as is the position to
    delete or update below: a plan that held the look-up would double with every change."""
    columns = [f for f in table.schema if f.name != POS]
    if any(len(r) < len(columns) for r in rows):
        raise ValueError(f"a row needs {len(columns)} values")
    schema = ", ".join(["pos long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)])
    start = (last_position(table) if last is None else last) + 1
    typed = lambda r: (float(v) if isinstance(f.dataType, FractionalType) and v is not None else v for v, f in zip(r, columns, strict=False))
    new = table.sparkSession.createDataFrame([(start + i, *typed(r)) for i, r in enumerate(rows)], schema)
    return table.unionByName(new)


def delete_first(table: DataFrame, column: str, value: int) -> DataFrame:
    """Without the first row that has the value; the same rows if none has it."""
    hit = first_position(table, column, value)
    return table if hit is None else table.filter(F.col(POS) != hit)


def delete_at(table: DataFrame, at: DataFrame) -> DataFrame:
    """Without the rows at the given positions."""
    return table.join(at.select(POS), POS, "left_anti").select(table.columns)


def update_first(table: DataFrame, column: str, old: int, new: int) -> DataFrame:
    """The first row that has the value `old` gets `new`."""
    hit = first_position(table, column, old)
    if hit is None:
        return table
    kind = table.schema[column].dataType
    return table.withColumn(column, F.when(F.col(POS) == hit, F.lit(new).cast(kind)).otherwise(F.col(column)))


def replay(table: DataFrame, column: str, writes: DataFrame) -> DataFrame:
    """table after a whole run of inserts and deletes (seq, op "insert" or "delete", value) as if one after the other.

    Columns other than `column` and pos of inserted rows are null. Rows of one value leave first in, first out. A delete
    finds nothing if all rows of its value are gone by then: over the run, the deletes that fail so far are the largest
    excess, up to any write, of deletes over inserts and rows from before. The others remove that many rows from the
    front, which a window finds that is limited to the largest such number before its shuffle, so neither untouched
    values nor all rows of a common one are sorted.
    """
    old = table.groupBy(column).agg(F.count("*").alias("_old"))
    moves = writes.select("seq", F.col("value").alias(column), F.when(F.col("op") == "insert", 1).otherwise(-1).alias("_d"))
    order = Window.partitionBy(column).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    excess = moves.join(old, column, "left").withColumn("_x", -F.sum("_d").over(order) - F.coalesce("_old", F.lit(0)))
    gone = excess.groupBy(column).agg((F.count(F.when(F.col("_d") < 0, 1)) - F.greatest(F.max("_x"), F.lit(0))).alias("_gone"))
    last = table.agg(F.coalesce(F.max(POS), F.lit(-1)).alias("_last"))
    added = writes.filter("op = 'insert'").join(F.broadcast(last))  # one row
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in (POS, column)]
    added = added.select((F.col("_last") + 1 + F.col("seq")).alias(POS), F.col("value").cast(table.schema[column].dataType).alias(column), *others)
    every, gone = table.unionByName(added.select(table.columns)), gone.filter("_gone > 0")
    most = gone.agg(F.max("_gone")).first()[0]
    if most is None:
        return every
    rank = F.row_number().over(Window.partitionBy(column).orderBy(POS))
    leaving = every.select(POS, column).join(gone, column).withColumn("_rank", rank).filter(F.col("_rank") <= most).filter("_rank <= _gone")
    return every.join(leaving.select(POS), POS, "left_anti").select(table.columns)


@dataclass
class Effect:
    """What a run of writes does to a table: positions that go, and rows (all columns but pos) that come or, where their
    position went as well, take a row's place. It has at most an entry of each kind for each write."""

    gone: set[int] = field(default_factory=set)
    rows: dict[int, list] = field(default_factory=dict)
    met: dict[int, tuple] = field(default_factory=dict)  # rows of the table that went, as they were


def effect(table: DataFrame, column: str, writes: list[tuple], last: int | None = None) -> Effect:
    """The effect of writes ("insert", values), ("delete", value) and ("update", old, new), one after the other: deletes
    and updates meet the first row by position that has the value at that time, which may be one that an earlier write
    put there. An update keeps the position, so rows of a value don't queue in the order of arrival; a heap of positions
    for each value gives the first. Of the table only the rows that so many writes on a value can reach are collected,
    at most one for each write, found by a window that is limited before its shuffle."""
    columns, out, heaps, given = [c for c in table.columns if c != POS], Effect(), {}, {}
    asked: dict[object, int] = {}
    for w in writes:
        if w[0] != "insert":
            asked[w[1]] = asked.get(w[1], 0) + 1
    if asked:
        of = table.schema[column]
        known = table.sparkSession.createDataFrame([(float(v) if isinstance(of.dataType, FractionalType) else v, n) for v, n in asked.items()], f"_value {of.dataType.simpleString()}, _n long")
        rank = F.row_number().over(Window.partitionBy(column).orderBy(POS))
        near = table.join(F.broadcast(known), F.col(column) == F.col("_value"))  # a row for each value asked for
        near = near.withColumn("_rank", rank).filter(F.col("_rank") <= max(asked.values())).filter("_rank <= _n")
        for r in near.select(POS, *columns).collect():
            given[r[0]] = tuple(r)[1:]
            heaps.setdefault(r[column], []).append(r[0])
    for heap in heaps.values():
        heapq.heapify(heap)
    at, number = (last_position(table) if last is None else last), columns.index(column)
    for kind, value, *rest in writes:
        if kind == "insert":
            at += 1
            out.rows[at] = [*value]
            heapq.heappush(heaps.setdefault(value[number], []), at)
        elif heap := heaps.get(value):
            pos = heapq.heappop(heap)
            if pos in given and pos not in out.gone:
                out.gone.add(pos)
                out.rows[pos], out.met[pos] = [*given[pos]], given[pos]
            if kind == "update":
                heapq.heappush(heaps.setdefault(rest[0], []), pos)
                out.rows[pos][number] = rest[0]
            else:
                del out.rows[pos]
    return out


def applied(table: DataFrame, what: Effect) -> DataFrame:
    """table after an effect."""
    spark, columns = table.sparkSession, [f for f in table.schema if f.name != POS]
    if what.gone:
        table = table.join(spark.createDataFrame([(p,) for p in sorted(what.gone)], f"{POS} long"), POS, "left_anti")
    if what.rows:
        fit = lambda v, f: float(v) if isinstance(f.dataType, FractionalType) and v is not None else v
        schema = ", ".join([f"{POS} long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)])
        table = table.unionByName(spark.createDataFrame([(p, *map(fit, row, columns)) for p, row in sorted(what.rows.items())], schema))
    return table
