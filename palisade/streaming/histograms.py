"""Keeping a workload's histogram up to date as operations arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.workload import BUCKET, BUCKETS


def windowed(operations: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, op, bucket, cnt) of operations (time, op, num1) by tumbling windows; rows later than `late` are left out.
    State is bounded by the windows that are still open, the operations and the buckets."""
    bucket = F.least(F.greatest(F.expr(f"num1 div {BUCKET}"), F.lit(0)), F.lit(BUCKETS - 1))
    by = operations.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "op", bucket.alias("bucket"))
    return by.agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "op", "bucket", "cnt")
