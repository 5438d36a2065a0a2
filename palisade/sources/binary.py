"""Binary database folders: a catalog file `dbinfo` and one little-endian int32 file per column."""

from __future__ import annotations

import struct
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.relational import POS
from palisade.sources.csvload import dense


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file, through Spark's readers."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def catalog(data: bytes) -> tuple[str, dict[str, tuple[int, list[str]]]]:
    """(database, table name to (rows, column names)) of a dbinfo file."""
    at = 0

    def take(kind: str):
        nonlocal at
        value = struct.unpack_from("<" + kind, data, at)[0]
        at += struct.calcsize("<" + kind)
        return value

    def name() -> str:
        n = take("i")
        return take(f"{n}s").rstrip(b"\0").decode()

    db, tables = name(), {}
    for _ in range(take("Q")):
        table, rows = name(), take("I")
        tables[table] = rows, [name() for _ in range(take("Q"))]
    return db, tables


def catalog_bytes(db: str, tables: dict[str, tuple[int, list[str]]]) -> bytes:
    text = lambda s: struct.pack("<i", len(s.encode())) + s.encode()
    out = [text(db), struct.pack("<Q", len(tables))]
    for table, (rows, columns) in tables.items():
        out += [text(table), struct.pack("<IQ", rows, len(columns)), *map(text, columns)]
    return b"".join(out)


def column(spark: SparkSession, path: str) -> DataFrame:
    """(pos, val) of an int32 file, read without Python. Spark splits the file at whole records; ids within splits give
    the positions."""
    context, session = spark._jsc.sc(), spark._jsparkSession
    records = context.binaryRecords(path, 4, spark._jsc.hadoopConfiguration())
    rows = DataFrame(session.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("raw")
    digits = F.concat(*(F.substring(F.hex("raw"), i, 2) for i in (7, 5, 3, 1)))  # the lowest byte comes first
    number = F.conv(digits, 16, 10).cast("long")
    value = F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number).cast("int")
    return dense(rows.select(value.alias("val"), F.monotonically_increasing_id().alias("_id")), "_id")


def write_column(values: DataFrame, name: str, path: str) -> int:
    """Write a column (pos, name) as one int32 file in the order of positions, and return how many values it has. The
    format has one file per column, so the values stream through the driver, some at a time."""
    spark = values.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out, count = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True), 0
    for some in batched(values.orderBy(POS).select(name).toLocalIterator(prefetchPartitions=True), 1 << 16):
        out.write(bytearray(np.array([r[0] for r in some], "<i4").tobytes()))
        count += len(some)
    out.close()
    return count


def write(spark: SparkSession, folder: str, db: str, tables: dict[str, DataFrame]) -> None:
    """A folder in this format from tables (pos and int columns); names are qualified by the database."""
    described = {}
    for name, rows in tables.items():
        columns = [c for c in rows.columns if c != POS]
        counts = [write_column(rows, c, f"{folder}/{name}.{c}") for c in columns]
        described[name] = counts[0], [f"{name}.{c}" for c in columns]
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/dbinfo")
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(catalog_bytes(db, described)))
    out.close()


def load(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame]]:
    """(database, table to rows with pos); nothing is read until a table is used."""
    db, tables = catalog(read_bytes(spark, f"{folder}/dbinfo"))
    out = {}
    for table, (_, columns) in tables.items():
        parts = [column(spark, f"{folder}/{c}").withColumnRenamed("val", c.rpartition(".")[2]) for c in columns]
        out[table] = reduce(lambda a, b: a.join(b, POS), parts)
    return db, out


def save(folder: str, db: str, tables: dict[str, pd.DataFrame]) -> None:
    """A folder in this format from frames on the driver, for interchange and tests."""
    with open(f"{folder}/dbinfo", "wb") as f:
        f.write(catalog_bytes(db, {t: (len(x), [f"{t}.{c}" for c in x.columns]) for t, x in tables.items()}))
    for t, x in tables.items():
        for c in x.columns:
            x[c].to_numpy(np.int32).astype("<i4").tofile(f"{folder}/{t}.{c}")
