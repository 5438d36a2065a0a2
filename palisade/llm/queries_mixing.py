"""Query op3_mixing and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import mixing
from palisade.llm.common import table, utf8_size

#: Percent of the mixed bytes for each source; "*" stands for unknown sources and null together.
WEIGHTS = {"src0": 10, "src1": 12, "src2": 11, "src3": 9, "src4": 8, "src5": 7, "src6": 5, "src7": 3, **{f"src{i}": 2 for i in range(8, 20)}, "*": 11}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (utf8_size(F.col("text")) + 8).alias("bytes"))
    out = mixing.mix(docs, WEIGHTS, F.col("bytes"))
    return out.select("doc_id", "bytes", *(F.col(f"mix.{c}").alias(c) for c in ("class", "block", "release", "deadline", "slot", "start")))


def _sql() -> str:
    total, n = sum(WEIGHTS.values()), len(WEIGHTS)
    named = ", ".join(f"({i}, '{c}', {w})" for i, (c, w) in enumerate(WEIGHTS.items()))
    w = f"[{', '.join(map(str, WEIGHTS.values()))}]"
    ready = f"""list_filter(range(1, {n + 1}), lambda i: done[i] < {w}[i] AND done[i] * {total} // {w}[i] <= t)"""
    chosen = f"""list_min(list_transform({ready}, lambda i: ((done[i] * {total} + {total} + {w}[i] - 1) // {w}[i]) * 1000 + i)) % 1000"""
    return f"""
WITH RECURSIVE named(i, class, w) AS (VALUES {named}),
frame(t, done, c) AS (
  SELECT CAST(0 AS BIGINT), list_transform({w}, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = c2 THEN 1 ELSE 0 END), c2
  FROM (SELECT t, done, CAST({chosen} AS BIGINT) AS c2 FROM frame WHERE t < {total})),
slots AS (SELECT class, w, t - 1 AS place, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS k FROM frame JOIN named ON named.i = c - 1),
docs AS (SELECT doc_id, CASE WHEN source IN (SELECT class FROM named WHERE class <> '*') THEN source ELSE '*' END AS class,
           coalesce(strlen(text), 0) + 8 AS bytes,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'size ' || (coalesce(strlen(text), 0) + 8))), 1, 7) AS BIGINT) % {mixing.BUCKETS} AS b FROM documents),
starts AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY class ORDER BY b, doc_id, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM docs),
blocks AS (SELECT starts.*, start // {mixing.BLOCK} AS block, w FROM starts JOIN named ON named.class = starts.class)
SELECT doc_id, bytes, blocks.class, block, block * {total} // blocks.w AS release,
       ((block + 1) * {total} + blocks.w - 1) // blocks.w AS deadline, block // blocks.w * {total} + place AS slot, start
FROM blocks JOIN slots ON slots.class = blocks.class AND slots.k = block % blocks.w"""


QUERIES = {"op3_mixing": op3_mixing}
ORACLE = {"op3_mixing": _sql()}
