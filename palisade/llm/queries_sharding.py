"""Query op1_sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import sharding
from palisade.llm.common import table, utf8_size

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"), (utf8_size(F.col("text")) + 8).alias("bytes"))
    out = sharding.assign(docs, F.col("bytes"), F.col("group"), bins=SHARDS, carry=("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE = {}
