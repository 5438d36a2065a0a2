"""Query op8_simhash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import simhash
from palisade.llm.common import spread, table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE = {}
