"""Query op7_secrets and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import secrets
from palisade.llm.common import spread, table


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), name="s").select("doc_id", "s")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.sha2(joined(F.filter("s", lambda x: x["base"])).cast("binary"), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), joined(F.col("s")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
ORACLE = {}
