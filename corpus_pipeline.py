"""Five stages over documents: quality rules, near-duplicates, secrets, mixing, packing.

Defined cases, in every stage: a null text counts as empty; columns besides those of documents pass through whatever
their names; an empty table stays empty. Rows that repeat are separate documents until the second stage, which keeps one
of them. Rows with a null id take part: the second stage keeps them last, the others treat them like any other.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import mixing, packing, quality, secrets, simhash
from palisade.llm.common import shared_dir, table, unused, utf8_size
from palisade.llm.queries_mixing import WEIGHTS
from palisade.llm.queries_packing import RANKS, TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff rejects. Empty texts go; a document without language
    is judged by the stratum null, and one in a stratum without enough labels by the base rules alone."""
    name = unused(docs.columns, "_quality")
    return quality.judge(docs, table(spark, sf_dir, "labels"), name=name).filter(F.col(f"{name}.kept")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates: fingerprints that differ in at most 2
    bits, or sets of 5-word shingles that are similar by 0.8 or more. An id that repeats with different texts stands for
    as many documents; nulls come after all ids, and of equal ids the first row stays."""
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew where one was. A null text stays null."""
    name = unused(docs.columns, "_masked")
    marked = docs.withColumn(name, secrets.masked(F.col("text")))
    size = F.coalesce(F.length(name).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return marked.withColumns({"text": F.coalesce(name, "text"), "n_chars": size}).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order: the files in the order of their names, and the rows within each, follow the
    schedule, so that a reader meets the sources in their target weights at any point. The next stage keeps to it. A null
    or unknown source has the weight of "*"."""
    return mixing.in_order(docs, WEIGHTS, utf8_size(F.col("text")) + 8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences. Pieces of one length are ranked in the order in which the
    rows of docs are filed, so the copies of each pattern follow the mixed order. A null text gives just the end id."""
    filed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    cut = packing.pieces(filed, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), order=("file", "row"))
    return packing.pack(cut, order=("row",), cell=F.col("file")).drop("file", "row")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", pack),
]
#: Fingerprints, schedules by hash order and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
