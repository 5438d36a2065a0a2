import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palisade.llm import simhash
from palisade.llm.queries_simhash import op8_simhash


def plain(text, width=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    """Smallest value of each component of links at 2 or fewer bits, by comparing all."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_query(spark, small, tables):
    text = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    prints = {i: plain(t) for i, t in text.items()}
    root, first = roots(set(prints.values())), {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash(spark, small).collect()}
    assert got == {i: (f"{p:016x}", first[root[p]]) for i, p in prints.items()}


def test_fingerprints_of_odd_texts():
    for t in (None, "", " \n", "one", "One TWO", "É é  x y", "a b c d " * 50_000):
        assert simhash.fingerprint(t) == plain(t)


def test_crowded_blocks(spark):
    """Many fingerprints under one key, chains, and far ones."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 400:
        v = rng.choice(sorted(values))
        for _ in range(rng.choice([1, 2, 3, 4])):
            v ^= 1 << rng.randrange(20)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    classes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes)).collect()}
    want = roots(values)
    groups = {}
    for v, r in want.items():
        groups.setdefault(r, set()).add(signed(v))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in found if found[n] == r) for r in set(found.values())}
    assert all(r == min(n for n in found if found[n] == r) for r in set(found.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {c for (i, _), c in by.items() if i in (1, 2, 3)} == {1} and {c for (i, _), c in by.items() if i in (4, 5)} == {4}
    kept = simhash.deduplicated(odd)
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect())
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and {1, 4, 7, 8, -9} <= set(ids) and not {2, 3, 5} & set(ids)
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_similar_texts(spark):
    """Copies with a few words changed meet; texts that share a third of their shingles stay apart."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(60):
        base = new(300)
        ids = []
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(300), 2):
                copy[at] = new(1)[0]
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        groups.append(ids)
        rows.append((len(rows), " ".join(base[:150] + new(150))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert left >= {i for i in range(len(rows)) if i % 5 in (0, 4)}
    assert sum(i in left for ids in groups for i in ids[1:]) <= 5


def exact_groups(rows, similarity=0.8, bits=2):
    """Groups of ids by links within so many bits or of at least that similarity of the sets of 5-word shingles, by comparing all."""
    sets, prints, root = {}, {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= bits or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def found_groups(spark, rows):
    marked, ids = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["key"]: r["first"]["key"] for r in marked.select("key", "fp").join(ids, "fp").collect()}


def test_repeated_ids(spark):
    """Rows that share an id but not the text each go with their own text; columns of any name stay."""
    new = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(4, new("a"), 1), (4, new("b"), 2), (5, new("a"), 3), (None, new("b"), 4), (None, new("c"), 5), (4, new("a"), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int").withColumns({c: F.lit(c) for c in ("row", "key", "fp", "_pl_kept", "name", "size")})
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(4, new("a")), (4, new("b")), (None, new("c"))], key=str)


def test_texts_of_one_fingerprint(spark):
    """Links of every text count, also where several different texts have one fingerprint."""
    base = [f"w{i}" for i in range(4000)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(i, changed(10 * i)) for i in range(30)]
    rows += [(100, " ".join(base[:3600])), (101, " ".join(base[:3300] + [f"y{i}" for i in range(200)]))]
    assert len({plain(t) for _, t in rows[:30]}) < 30
    assert found_groups(spark, rows) == exact_groups(rows)


def test_similarity_is_exact(spark):
    """Pairs just above and just below 0.8 are told apart."""
    rng = random.Random(7)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        cut = 267 if g % 2 else 266  # 267 of 333 shingles are common to both, or 266 of 334
        rows += [(2 * g, " ".join(base[:304])), (2 * g + 1, " ".join(base[: cut + 4] + [f"v{rng.randrange(10**6)}" for _ in range(300 - cut)]))]
    want = exact_groups(rows)
    assert len(set(want.values())) == 60
    assert found_groups(spark, rows) == want


def test_prefixes():
    """Sets that are similar by 0.8 share a shingle of their prefixes, whatever is known of the frequencies."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 500]:
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            common = np.sort(rng.choice(x, rng.integers(0, len(x) + 1), replace=False))
            counts = rng.integers(3, 9, len(common))
            most = n // 5  # x and what is left without so many are similar by 0.8
            y = np.sort(rng.permutation(x)[most:])
            assert set(simhash.prefix(x, common, counts, 0.8)) & set(simhash.prefix(y, common, counts, 0.8))


def test_recall_with_many_documents(spark):
    """All pairs at 0.8 are found, however many other documents there are."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(60_000)]
    pairs = 60
    for g in range(pairs):
        words = rows[g][1].split()
        rows.append((60_000 + g, " ".join(words[:50] + [f"v{g}"])))  # 46 of 57 shingles
        rows[g] = (g, " ".join(words))
    got = found_groups(spark, rows)
    assert [got[60_000 + g] for g in range(pairs)] == list(range(pairs))


def test_crowded_shingles(spark, monkeypatch):
    """Pairs that share only a passage, with many texts that hold it as well but are below 0.8, are found."""
    rng = random.Random(13)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(204)
    rows = [(i, " ".join((passage[:180] if i % 2 else passage[24:]) + new(5))) for i in range(60)]  # two groups, 0.78 similar to the next ones
    rows += [(60 + i, " ".join(passage + new(20))) for i in range(3)]  # 0.83 similar to each other
    want = exact_groups(rows, bits=0)
    monkeypatch.setattr(simhash, "links", lambda classes: classes.selectExpr("fp AS a", "fp AS b").limit(0))
    assert {want[60 + i] for i in range(3)} == {60} and len(set(want.values())) == 3
    assert found_groups(spark, rows) == want
