"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for the white space that separates words (space, tab to carriage return).
SPACES = "[\\x20\\x09-\\x0D]+"


def by_value(module: str) -> None:
    """Send the functions of a module to executors by value, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: below spark.checkpoint.dir, or below one set here
    if none is and the master is local. It is deleted when the application ends; what is to stay is written to a folder of
    the caller's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="palisade-")
            spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/palisade-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: Whether shuffle files are removed as soon as a query has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. The shuffle
    files behind it aren't needed any more then, and go."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*dfs: DataFrame) -> None:
    """Delete what materialise wrote for frames that nothing reads any more."""
    for df in dfs:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value as a column that is computed in one place: the optimizer neither copies it into filters nor moves it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unused(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (one large row group, say) is dealt to all of them, for work that
    is dear by row. Scans of larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
