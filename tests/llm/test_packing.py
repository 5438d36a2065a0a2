import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palisade.llm import packing
from palisade.llm.queries_packing import RANKS, TOKENIZER, op6_packing

PATHS = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
SLOW, FAST = Tokenizer.from_file(PATHS[0]), packing.encoder(*PATHS)


def ids_of(text):
    return [*SLOW.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts):
    """Every id lies in one piece, pieces of a sequence don't overlap, and little is padded."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in docs.items():
        at, ids = 0, ids_of(texts[i])
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(docs) == set(texts)
    assert sorted(sequences) == list(range(len(sequences)))
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
        padded += 0 if at.bit_count() == 1 else 1024 - at
    return padded / total


def test_query(spark, small, tables):
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    assert check(op6_packing(spark, small).collect(), texts) < 0.01


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text("aéñß 1.,\n'tT  \x1c") | st.just("<|endoftext|> a"))
def test_fast_encoder_agrees(text):
    assert FAST(text).tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("n", [1, 15, 16, 17, 511, 512, 513, 1023, 1024, 1025, 1537, 5000])
def test_cuts(n):
    cut = packing.cuts(n, 1024)
    assert [a for a, _ in cut] == [0, *(b for _, b in cut[:-1])] and cut[-1][1] == n and all(0 < b - a <= 1024 for a, b in cut)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = Counter(b - a for x in rng.lognormal(6, 1, 3000).astype(int) + 1 for a, b in packing.cuts(int(x), 1024))
    demand.pop(1024, None)
    placed, used = Counter(), 0
    for copies, pattern in packing.plan(dict(demand)):
        assert sum(x * n for x, n in pattern.items()) <= 1024 and copies > 0
        placed.update({x: n * copies for x, n in pattern.items()})
        used += copies
    assert placed == demand and used <= 1.003 * sum(x * n for x, n in demand.items()) / 1024 + 2


def test_knapsack():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths, prices = np.array(sorted(rng.choice(np.arange(1, 30), 5, replace=False))), rng.random(5)
        best = [0.0] * 41
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - x] + p for x, p in zip(lengths.tolist(), prices, strict=True) if x <= c)])
        value, counts = packing.knapsack(prices, lengths, 40)
        assert value == pytest.approx(best[40]) and counts @ prices == pytest.approx(value) and counts @ lengths <= 40


def test_odd_rows(odd, empty):
    assert packing.pack(packing.pieces(empty, *PATHS)).count() == 0
    named = odd.filter("doc_id IS NOT NULL AND doc_id <> 4")
    texts = {r["doc_id"]: r["text"] for r in named.collect()}
    check(packing.pack(packing.pieces(named, *PATHS)).collect(), texts)
    assert packing.pack(packing.pieces(odd, *PATHS)).groupBy("doc_id", "start").count().filter("count = 2").count() >= 2


def test_sequences_hold_the_ids(odd):
    named = odd.filter("doc_id > 5")
    packed = packing.pack(packing.pieces(named, *PATHS, with_ids=True))
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(len(x) == 1024 or len(x).bit_count() == 1 for x in rows.values())
    texts = {r["doc_id"]: r["text"] for r in named.collect()}
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids_of(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
