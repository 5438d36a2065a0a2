"""Load files: an optional line `rows,columns`, a line of qualified column names, then rows of whole numbers; an
empty cell is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from palisade.operators.relational import POS


def header(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(qualified names, header lines)."""
    lines = [r["value"].strip() for r in spark.read.text(path).limit(2).collect()]
    if not lines:
        raise ValueError(f"{path} is empty")
    counted = all(x.strip().isdigit() for x in lines[0].split(","))
    if counted and len(lines) < 2:
        raise ValueError(f"{path} has no column names")
    names = [x.strip() for x in lines[1 if counted else 0].split(",")]
    if counted and int(lines[0].split(",")[1]) != len(names):
        raise ValueError(f"{path} names {len(names)} columns and announces others")
    return names, 1 + counted


def load(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(qualified names, rows with pos): pos follows the order of the lines. A folder may hold several load files with
    equal headers; each one's rows stay together."""
    names, skip = header(spark, path)
    schema = StructType([StructField(n.rpartition(".")[2], IntegerType()) for n in names])
    lines = fixed(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id")))
    # the ids grow along a file; the header's are the smallest of its
    firsts = lines.groupBy("_file").agg(F.min("_id").alias("_first"))
    rows = lines.join(F.broadcast(firsts), "_file").filter((F.col("_id") >= F.col("_first") + skip) & (F.trim("value") != ""))  # a row per file
    cells = F.split("value", ",")
    out = rows.select("_first", "_id", *(F.nullif(F.trim(cells[i]), F.lit("")).cast("int").alias(f.name) for i, f in enumerate(schema)))
    return names, dense(out, "_id", "_first")  # the last splits of files come after all the longer ones


def fixed(rows: DataFrame) -> DataFrame:
    """rows of one RDD, so that each use has the same partitions. Each scan of files draws up its own, by settings and by
    the cores that the cluster has at that moment, and ids of two scans need not agree."""
    spark = rows.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD(), rows._jdf.schema()), spark)


def dense(rows: DataFrame, order: str, *first: str) -> DataFrame:
    """rows with pos gapless from 0 in the given order, which must be a monotonically_increasing_id: its upper bits
    are the partition, so numbers are counted within partitions and offset by those before. Rows go by the columns
    `first` before that, of few different values. The ids are made twice, so they must be those of one RDD: a sort draws
    its bounds anew each time, and a scan of files its partitions, and rows would be lost or numbered twice."""
    rows, cell = rows.withColumn("_part", F.shiftright(order, 33)), [*first, "_part"]
    before = F.sum("_n").over(Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(before, F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(order)) - 1
    out = rows.withColumn("_rank", rank).join(F.broadcast(parts), cell)  # a row per partition and file
    columns = [c for c in rows.columns if c not in (order, *cell)]
    return out.select((F.col("_rank") + F.col("_off")).cast(LongType()).alias(POS), *columns)


def statistics(spark: SparkSession, path: str) -> tuple[int, int]:
    """(lines, fields of the first line)."""
    lines = spark.read.text(path)
    first = lines.first()
    return lines.count(), len(first["value"].split(",")) if first else 0


def write(table: DataFrame, qualified: str, path: str) -> None:
    """A load file (a folder of one part): for interchange, so in one task."""
    columns = [c for c in table.columns if c != POS]
    null = F.lit("") if len(columns) > 1 else F.raise_error(F.lit("a null alone would be a blank line"))
    body = table.select(F.col(POS), F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), null) for c in columns)).alias("value"))
    head = table.sparkSession.createDataFrame([(-2, f"{table.count()},{len(columns)}"), (-1, ",".join(f"{qualified}.{c}" for c in columns))], "pos long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions(POS).select("value").write.text(path)
