import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import sharding
from palisade.llm.common import utf8_size
from palisade.llm.queries_sharding import op1_sharding


def slow(sizes, capacity):
    """Best fit item by item, with a scan of all bins."""
    bins, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(bins) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(max(capacity, s))
        bins[b] -= s
        out.append((s, b))
    return sorted(out)


def counted(sizes):
    return [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40, 70]) if seed % 2 else rng.randrange(1, 90) for _ in range(150)]
    runs = sharding.best_fit(counted(sizes), 100)
    assert sorted((s, b) for s, a, z, b in runs for _ in range(a, z)) == slow(sizes, 100)


def test_tree_stays_balanced():
    rng, tree, held = random.Random(1), sharding.Tree(), []
    for i in range(3000):
        if held and rng.random() < 0.4:
            x = held.pop(rng.randrange(len(held)))
            tree.remove(x)
        else:
            x = (rng.randrange(1000), i)
            held.append(x)
            tree.add(x)
        want = rng.randrange(1000)
        assert tree.tightest(want) == min((x for x in held if x[0] >= want), default=None)
    assert tree.height[tree.root] <= 1.45 * len(held).bit_length() + 2


@pytest.mark.parametrize("sizes", [[], [5], [1000, 1, 1, 1], [7] * 100, list(range(1, 60))])
def test_even(sizes):
    runs = sharding.even(counted(sizes), 5)
    load = [0] * 5
    for s, a, z, b in runs:
        load[b] += s * (z - a)
    assert sum(load) == sum(sizes)
    assert sorted((s, i) for s, a, z, b in runs for i in range(a, z)) == sorted((s, i) for s, n in counted(sizes) for i in range(n))
    if len(sizes) > 50:
        assert max(load) - min(load) <= max(sizes)


def check(docs, out, n):
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < n
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return rows


def test_query(spark, small, tables):
    docs = tables["documents"].toPandas()
    rows = check(tables["documents"], op1_sharding(spark, small), 24)
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    where, load = {}, [0] * 24
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
    assert max(load) <= max(1.01 * sum(load) / 24 + 8, max(len(t.encode()) + 8 for t in text.values()))


def test_odd_rows(odd, empty):
    for docs in (odd, empty):
        args = (utf8_size(F.col("text")) + 8, F.md5(F.coalesce("text", F.lit(""))))
        check(docs, sharding.assign(docs, *args, bins=4), 4)
        out = sharding.assign(docs, *args, capacity=3000)
        rows = check(docs, out, 100)
        load = {}
        for r in rows:
            load.setdefault(r["shard"], []).append(r["size"])
        assert all(sum(s) <= 3000 or len(set(s)) == 1 for s in load.values())
