"""Query op2_warc and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import warc
from palisade.llm.common import table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.build(warc.write(pages))
    records = warc.read(warc.lookup(warc.keys(pages), index))
    return records.selectExpr("id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql() -> str:
    # base32 of the SHA-1: each 5 hexadecimal digits are 4 letters
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s} & 31), 1)" for i in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


QUERIES = {"op2_warc": op2_warc}
ORACLE = {"op2_warc": _sql()}
