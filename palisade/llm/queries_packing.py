"""Query op6_packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import packing
from palisade.llm.common import spread, table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)))


QUERIES = {"op6_packing": op6_packing}
ORACLE = {}
