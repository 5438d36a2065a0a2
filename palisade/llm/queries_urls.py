"""Query op9_url_rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import url_rules
from palisade.llm.common import table


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, mined).select("page_id", "_u.host", "_u.path", "_u.rule", "_u.verdict")


def url_rules_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on labels that call most urls with a directory `de` bad, and a tenth of all others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when(F.contains("url", F.lit("/de/")), F.col("page_id") % 10 < 9).otherwise(F.col("page_id") % 10 == 0)
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    return url_rules.judge(pages, url_rules.mine(pages, labels)).select("page_id", "_u.host", "_u.path", "_u.rule", "_u.verdict")


def _sql(labels: str = "labels") -> str:
    """Mining by a plain search level by level."""
    ranked = sorted(url_rules.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ranked)
    action = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in ranked)
    tag = lambda kind, xs: f"list_transform(list_filter({xs}, lambda x: x <> ''), lambda x: '{kind}' || x)"
    dirs = "string_split(path, '/')"
    return rf"""
WITH RECURSIVE cut AS (SELECT row_number() OVER () AS rn, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
u AS (SELECT *, list_distinct({tag("h:", "string_split(host, '.')")} || {tag("p:", f"list_slice({dirs}, 1, len({dirs}) - 1)")}
            || {tag("q:", "list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1])")}) AS items FROM parts),
marks AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM {labels} WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
seen AS (SELECT u.rn, bad, items FROM u JOIN marks ON u.page_id = marks.doc_id WHERE len(items) > 0),
least AS (SELECT greatest({url_rules.MIN_COUNT}, CAST(floor({url_rules.MIN_SUPPORT} * count(*)) AS BIGINT)) AS n FROM seen WHERE bad),
each AS (SELECT rn, bad, unnest(items) AS item FROM seen),
common AS (SELECT item, count(*) AS n FROM each WHERE bad GROUP BY item HAVING count(*) >= (SELECT n FROM least)),
basket AS (SELECT rn, each.item FROM each JOIN common ON each.item = common.item WHERE bad),
total AS (SELECT count(*) FILTER (WHERE bad) / count(*) AS share FROM seen),
sets AS (
  SELECT [item] AS items, list(rn) AS rows FROM basket GROUP BY item HAVING count(*) >= (SELECT n FROM least)
  UNION ALL
  SELECT list_append(s.items, b.item), list(b.rn) FROM sets s, LATERAL (SELECT unnest(s.rows) AS rn) r JOIN basket b ON b.rn = r.rn
  WHERE b.item > s.items[len(s.items)] GROUP BY s.items, b.item HAVING count(*) >= (SELECT n FROM least)),
rated AS (SELECT s.items, count(*) FILTER (WHERE bad) AS support, count(*) AS n, avg(CAST(bad AS INT)) AS confidence FROM sets s JOIN seen ON list_has_all(seen.items, s.items) GROUP BY s.items),
kept AS (SELECT * FROM rated WHERE support >= (SELECT n FROM least) AND confidence >= {url_rules.MIN_CONFIDENCE}
         AND support - n * (SELECT share FROM total) >= {url_rules.SURE} * sqrt(n * (SELECT share * (1 - share) FROM total))),
hit AS (SELECT DISTINCT rn FROM u JOIN kept ON list_has_all(u.items, kept.items))
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {action} END, CASE WHEN hit.rn IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit ON u.rn = hit.rn"""


_PLANTED = """(SELECT page_id AS doc_id, CASE WHEN CASE WHEN contains(url, '/de/') THEN page_id % 10 < 9 ELSE page_id % 10 = 0 END THEN 0 ELSE 1 END AS quality, 0 AS toxic FROM pages)"""
QUERIES = {"op9_url_rules": op9_url_rules, "url_rules_planted": url_rules_planted}
ORACLE = {"op9_url_rules": _sql(), "url_rules_planted": _sql(_PLANTED)}
