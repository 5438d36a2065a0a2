"""Range partitioning of a table on the values of one column.

Partition i holds the values above pivot i-1 and up to pivot i; the last one takes everything above, and nulls. The
assignment is stable: rows of a partition keep their order. On disk every partition is a directory `part_id=i`, and since
Spark can't derive part_id from a predicate on the column, selections here add the partitions that can hold matches.

A `Store` is a layout under change: each write of some partitions makes directories `version=v/part_id=i` beside the ones
before, which stay as they are for frames that read them. The store knows the version of each partition.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, IntegralType, StructField, StructType

from palisade.functions.comparators import between
from palisade.functions.lookup import partition_of, place
from palisade.operators.relational import POS

PART, VERSION = "part_id", "version"


@dataclass(frozen=True)
class Layout:
    """Ascending pivots of a column and, per partition, the share of free slots for later inserts (`ghosts`)."""

    column: str
    pivots: tuple[int, ...]
    ghosts: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not self.pivots or list(self.pivots) != sorted(set(self.pivots)):
            raise ValueError("pivots ascend, and there is at least one")

    def part(self, value) -> int:
        return place(list(self.pivots), value)

    def span(self, low, high, whole: bool = True) -> tuple[int, int]:
        """First and last partition that can hold low <= value < high. whole: values are whole numbers, so none lies
        between high - 1 and high."""
        last = len(self.pivots) - 1 if high is None else self.part(high - 1 if whole else high)
        return 0 if low is None else self.part(low), last


def whole(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def assign(table: DataFrame, layout: Layout) -> DataFrame:
    return table.withColumn(PART, partition_of(F.col(layout.column), list(layout.pivots)))


def sizes(assigned: DataFrame) -> DataFrame:
    """(part_id, size) of the partitions that hold rows."""
    return assigned.groupBy(PART).agg(F.count("*").alias("size"))


def info(assigned: DataFrame, layout: Layout) -> DataFrame:
    """(part_id, pivot, size, last) for every partition; last is the last new position in it, inclusive. The table has
    a row per partition, so the running sum is over few rows."""
    spark = assigned.sparkSession
    every = spark.createDataFrame([(i, p) for i, p in enumerate(layout.pivots)], "part_id int, pivot long")
    joined = every.join(sizes(assigned), PART, "left").select(PART, "pivot", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    running = F.sum("size").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("last", running - 1)


def info_json(assigned: DataFrame, layout: Layout) -> DataFrame:
    """One row: sizes and pivots as JSON."""
    rows = info(assigned, layout)
    ordered = F.sort_array(F.collect_list(F.struct(PART, "size", "pivot")))
    return rows.agg(ordered.alias("p")).select(F.to_json(F.struct(F.col("p.size").alias("sizes"), F.col("p.pivot").alias("pivots"))).alias("info"))


def remap(assigned: DataFrame, layout: Layout) -> DataFrame:
    """(pos, part_id, new_pos): positions after stable partitioning. Rows are numbered within ranges of positions and
    partitions, so that no partition, however large, is numbered by one task."""
    step = 1 << 20
    cells = assigned.select(POS, PART, F.expr(f"{POS} div {step}").alias("_cell"))
    counts = cells.groupBy(PART, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(PART).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(PART, "_cell", F.coalesce(before, F.lit(0)).alias("_off"))
    starts = info(assigned, layout).select(PART, (F.col("last") + 1 - F.col("size")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(PART, "_cell").orderBy(POS)) - 1
    joined = cells.withColumn("_rank", rank).join(counts, [PART, "_cell"]).join(F.broadcast(starts), PART)  # a row per partition
    return joined.select(POS, PART, (F.col("_start") + F.col("_off") + F.col("_rank")).alias("new_pos"))


def shown(assigned: DataFrame) -> DataFrame:
    """All rows with is_fence, true for the last position of each partition."""
    last = assigned.groupBy(PART).agg(F.max(POS).alias("_last"))
    return assigned.join(last, PART).withColumn("is_fence", F.col(POS) == F.col("_last")).drop("_last")


def scan_partition(assigned: DataFrame, part: int, test: Column | None = None) -> DataFrame:
    """Rows of one partition, optionally with a test."""
    rows = assigned.filter(F.col(PART) == part)
    return rows if test is None else rows.filter(test)


def select_range(assigned: DataFrame, layout: Layout, low: int | None, high: int | None) -> DataFrame:
    """low <= column < high, reading only the partitions between those of the bounds."""
    if low is not None and high is not None and low >= high:
        return assigned.filter(F.lit(False))
    first, last = layout.span(low, high, whole(assigned.schema[layout.column].dataType))
    return assigned.filter(F.col(PART).between(first, last) & between(F.col(layout.column), low, high))


def select_first(assigned: DataFrame, layout: Layout, value: int) -> DataFrame:
    """The first row by position with the value, reading one partition."""
    return assigned.filter((F.col(PART) == layout.part(value)) & (F.col(layout.column) == value)).orderBy(POS).limit(1)


def write(table: DataFrame, layout: Layout, path: str) -> None:
    """Write a directory per partition. Rebalancing gathers the rows of a partition and splits large ones."""
    assign(table, layout).hint("rebalance", PART).write.partitionBy(PART).parquet(path)


def replace(table: DataFrame, layout: Layout, path: str, parts: list[int]) -> None:
    """Write the given partitions anew and leave the others as they are. They must not be empty afterwards."""
    rows = assign(table, layout).filter(F.col(PART).isin(parts)).hint("rebalance", PART)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class Store:
    """Where the partitions of a laid-out table are: `held` maps a partition to the version that holds it. Versions are
    random numbers, so several sessions can go on from one saved store. sort: a column that orders files."""

    path: str
    layout: Layout
    schema: StructType  # without part_id
    sort: str | None = None
    held: dict[int, int] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it is now. Each partition held is listed, so part_id prunes directories."""
        typed = StructType([*self.schema, StructField(VERSION, IntegerType()), StructField(PART, IntegerType())])
        if not self.held:
            return spark.createDataFrame([], typed).drop(VERSION)
        paths = [f"{self.path}/{VERSION}={v}/{PART}={i}" for i, v in sorted(self.held.items())]
        return spark.read.schema(typed).option("basePath", self.path).parquet(*paths).drop(VERSION)

    def write(self, rows: DataFrame, parts: list[int] | None = None) -> None:
        """Write the given partitions (all, if none are given) from rows with part_id. Emptied ones are held no more."""
        spark, version = rows.sparkSession, uuid.uuid4().int >> 98
        rows = rows if parts is None else rows.filter(F.col(PART).isin(parts))
        folder = f"{self.path}/{VERSION}={version}"
        rows = rows.select(*self.schema.names, PART).hint("rebalance", PART)
        if self.sort:
            rows = rows.sortWithinPartitions(PART, self.sort)
        rows.write.partitionBy(PART).parquet(folder)
        listed = spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in listed.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(listed)]
        made = [int(n.rpartition("=")[2]) for n in names if n.startswith(f"{PART}=")]
        kept = {} if parts is None else {i: v for i, v in self.held.items() if i not in parts}
        self.held = kept | dict.fromkeys(made, version)


def equal_depth(table: DataFrame, column: str, parts: int) -> Layout:
    """Pivots at the quantiles, from a sketch of bounded size; `tiles` gives exact ones."""
    shares = [(i + 1) / parts for i in range(parts)]
    cut = table.agg(F.percentile_approx(column, shares, 10_000).alias("q"), F.max(column).alias("m")).first()
    if cut["m"] is None:
        return Layout(column, (0,))
    return Layout(column, tuple(sorted({*map(int, cut["q"]), int(cut["m"])})))


def equal_width(table: DataFrame, column: str, parts: int) -> Layout:
    low, high = table.agg(F.min(column), F.max(column)).first()
    if high is None:
        return Layout(column, (0,))
    return Layout(column, tuple(sorted({int(low + (high - low) * (i + 1) // parts) for i in range(parts)})))


def running(values: DataFrame, column: str, count: str, cells: int = 256) -> DataFrame:
    """values with `upto`: the sum of counts up to and with each value. Values are summed within cells that hold about
    equally many of them, and offset by the sums of the cells before."""
    cut = equal_depth(values, column, cells)
    celled = values.withColumn("_cell", partition_of(F.col(column), list(cut.pivots)))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = celled.groupBy("_cell").agg(F.sum(count).alias("_n")).select("_cell", F.coalesce(before, F.lit(0)).alias("_off"))
    within = F.sum(count).over(Window.partitionBy("_cell").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    # a row per cell
    return celled.withColumn("_in", within).join(F.broadcast(sums), "_cell").withColumn("upto", F.col("_in") + F.col("_off")).drop("_cell", "_in", "_off")


def tiles(table: DataFrame, column: str, parts: int) -> DataFrame:
    """(tile, pivot, size): the exact equal-depth tiles by value and position, from the counts of values alone. The first
    tiles hold one row more than the others, so the tiles that end among a value's rows follow by arithmetic."""
    small, more = divmod(table.count(), parts)
    spread = running(table.groupBy(column).agg(F.count("*").alias("n")), column, "n")
    ended = lambda rows: f"if({rows} <= {more * (small + 1)}, ({rows}) div {small + 1}, {more} + ({rows} - {more * (small + 1)}) div {max(1, small)})"
    hit = spread.select(F.col(column).alias("pivot"), F.expr(f"{ended('(upto - n)')} + 1").alias("a"), F.expr(ended("upto")).alias("b")).filter("a <= b")
    hit = hit.select("pivot", F.explode(F.sequence("a", "b")).alias("tile"))
    return hit.select(F.col("tile").cast("int").alias("tile"), "pivot", F.when(F.col("tile") <= more, small + 1).otherwise(small).cast("long").alias("size"))


def sorted_layout(table: DataFrame, column: str) -> DataFrame:
    """The table in range partitions, each sorted."""
    return table.repartitionByRange(F.col(column)).sortWithinPartitions(column)
