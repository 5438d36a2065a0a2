"""Query op4_toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import toxicity
from palisade.llm.common import spread, table


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE = {}
