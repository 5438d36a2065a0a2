"""Query op5_neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import neighbours
from palisade.llm.common import table


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op5_neighbours": op5_neighbours}
ORACLE = {}
