"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from palisade.llm import queries_mixing, queries_neighbours, queries_packing, queries_quality, queries_secrets, queries_sharding, queries_simhash, queries_toxicity, queries_urls, queries_warc

MODULES = [
    queries_sharding,
    queries_warc,
    queries_mixing,
    queries_toxicity,
    queries_neighbours,
    queries_packing,
    queries_secrets,
    queries_simhash,
    queries_urls,
    queries_quality,
]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
