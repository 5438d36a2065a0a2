import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import secrets
from palisade.llm.queries_secrets import op7_secrets

KEYS = re.match(r"\((\w+)", secrets.RULES[0].pattern)[1]


def slow(text):
    """Spans by trying every expression on the whole text."""
    out = []
    for k, r in enumerate(secrets.RULES):
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text, flags) if len(m[r.group]) >= r.least]
    return sorted(out)


PARTS = [KEYS, "API_KEY", "apikey", "Secret", "toKen", "token", "ſecret", "=", ": ", '"', "'", " ", "abc", "abcdef", "AKIA", "akia", "ABCDEFGH12345678", "0123456789abcdef", "ghp_", "a" * 36, "xoxb-", "-" * 5, "BEGIN RSA PRIVATE KEY-----", "http://u:pw1@h", "eyJabcdefghi.", "\n", "é", "İ", "sk_live_", "AIza"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_index_finds_what_scans_find(texts):
    assert secrets.spans(texts) == [slow(t) for t in texts]


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("abcd", ("and", frozenset({"abc", "bcd"}))),
        ("abc|xyz", ("or", frozenset({"abc", "xyz"}))),
        ("a?bcd", "bcd"),
        ("[0-9a-f]+", True),
        ("ab", True),
        ("AKIA[A-Z]+", ("and", frozenset({"aki", "kia"}))),
        ("x{3}y", ("and", frozenset({"xxx", "xxy"}))),
        ("(abc)*d", True),
        ("(abc)+", "abc"),
        ("abc.*(def|ab)", "abc"),
    ],
)
def test_queries_of_patterns(pattern, query):
    assert secrets.trigrams(pattern) == query


def test_index_is_complete():
    """Postings hold a text exactly if it holds the trigram, across stretches as well."""
    texts = ["", "ab", "abc", "xxABCxx", "é" * 7 + "abc", "a" * (secrets.STRETCH - 1) + "bc" + "z" * 9, "b" * (2 * secrets.STRETCH) + "abc"]
    names = {"abc", "aab", "bbb", "zzz", "qqq"}
    found = secrets.Index(texts, secrets.Grams(names)).postings
    assert {g: p.tolist() for g, p in found.items()} == {g: [i for i, t in enumerate(texts) if g in t.lower()] for g in names}


@pytest.mark.parametrize("part", ["eyJ", "eyJaaaaaaaa.", "ghp_", "xoxb-", "-----BEGIN A ", "token ", "http://a:", "AKIA", "sk_live_", "f"])
def test_long_texts_take_linear_time(part):
    def seconds(n):
        text, best = part * (n // len(part)), 9.0
        for _ in range(3):
            began = time.perf_counter()
            secrets.spans([text])
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(400_000) < 20 * (seconds(50_000) + 0.005)


def test_query(spark, small, tables):
    kinds = [r.kind for r in secrets.RULES]
    joined = lambda xs: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in xs)
    text = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    rows = op7_secrets(spark, small).collect()
    assert len(rows) == len(text)
    for r in rows:
        found = slow(text[r["doc_id"]])
        base = [x for x in found if x[1] < 3]
        assert r["spans"] == joined(found) and r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]


def test_odd_rows(odd, empty):
    assert secrets.find(empty).count() == 0
    out = secrets.find(odd)
    rows = out.select("text", "secrets").collect()
    assert len(rows) == odd.count() and set(out.columns) == set(odd.columns)
    assert all([(x["start"], x["end"]) for x in r["secrets"]] == [(a, b) for a, _, b in slow(r["text"] or "")] for r in rows)


def test_redaction(spark):
    secret = f"{KEYS}: " + "0123456789abcdef" * 2
    texts = ["plain é", None, "", f"é😀 {secret} end", secret, f"{secret} {secret}"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(secrets.masked(F.col("text")).alias("r")).collect()
    assert [r["r"] for r in rows] == [None, None, None, "é😀 [SECRET] end", "[SECRET]", "[SECRET] [SECRET]"]
