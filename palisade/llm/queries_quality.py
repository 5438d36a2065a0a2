"""Query op10_quality and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import quality
from palisade.llm.common import spread, table

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    out = quality.judge(docs, table(spark, sf_dir, "labels"), narrow=True)
    return out.select("doc_id", *(f"_q.{c}" for c in FIGURES))


def quality_rules_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every document labelled (good unless it holds "##" or "%%") and twice the risk, so that cutoffs are
    certified on small tables too."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    labels = docs.select("doc_id", F.when(F.col("text").rlike("##|%%"), 0).otherwise(1).alias("quality"))
    out = quality.judge(docs, labels, narrow=True, alpha=PLANTED_ALPHA)
    return out.select("doc_id", *(f"_q.{c}" for c in FIGURES))


PLANTED_ALPHA = 0.1


def _sql(labels: str = "labels", alpha: float = quality.ALPHA) -> str:
    div = {
        "symbols": "n_symbols * 1000 // n_words",
        "dup_lines": "n_dup_lines * 1000 // n_words",
        "long_words": "word_chars * 100 // n_words",
        "short_words": "-(word_chars * 100 // n_words)",
        "repeats": "n_repeat_words * 1000 // n_words",
    }
    grid = ", ".join(f"('{s}', {c})" for s, (_, cuts) in quality.SIGNALS.items() for c in cuts)
    risk = alpha / len(quality.SIGNALS)
    pairs = " UNION ALL ".join(f"SELECT doc_id, lang, rn, '{s}' AS signal, CASE WHEN n_words > 0 THEN {e} END AS v FROM fig" for s, e in div.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rn),
lines AS (SELECT rn, count(*) - count(DISTINCT l) AS n FROM (SELECT rn, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^ \t\n\x0b\f\r]') GROUP BY rn),
fig AS (SELECT w.rn, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
          CAST(length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN rep ON w.rn = rep.rn LEFT JOIN lines ON w.rn = lines.rn),
base AS (SELECT rn, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM fig),
sig AS (SELECT p.* FROM ({pairs}) p JOIN base ON p.rn = base.rn WHERE NOT base_failed),
good AS (SELECT doc_id FROM {labels} GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT sig.doc_id, lang, signal, max(v) AS v FROM sig JOIN good ON sig.doc_id = good.doc_id GROUP BY ALL),
grid(signal, cut) AS (VALUES {grid}),
n AS (SELECT lang AS s, count(DISTINCT doc_id) AS n FROM held GROUP BY lang),
k AS (SELECT lang AS s, grid.signal, cut, count(*) FILTER (WHERE v > cut) AS k FROM held JOIN grid ON grid.signal = held.signal GROUP BY ALL),
sure AS (SELECT k.s, signal, cut FROM k JOIN n ON k.s IS NOT DISTINCT FROM n.s WHERE k < n * {risk!r} AND list_sum(list_transform(range(0, k + 1),
          lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) <= {quality.DELTA / len(quality.SIGNALS)!r} / (SELECT count(*) FROM n)),
cuts AS (SELECT s, signal, min(cut) AS cut FROM sure GROUP BY ALL),
bad AS (SELECT DISTINCT rn FROM sig JOIN cuts ON cuts.s IS NOT DISTINCT FROM sig.lang AND cuts.signal = sig.signal WHERE v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.rn IS NULL AS kept
FROM fig JOIN base ON fig.rn = base.rn LEFT JOIN bad ON fig.rn = bad.rn"""


_PLANTED = "(SELECT doc_id, CASE WHEN regexp_matches(text, '##|%%') THEN 0 ELSE 1 END AS quality FROM documents)"
QUERIES = {"op10_quality": op10_quality, "quality_rules_planted": quality_rules_planted}
ORACLE = {"op10_quality": _sql(), "quality_rules_planted": _sql(_PLANTED, PLANTED_ALPHA)}
