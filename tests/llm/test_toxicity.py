import random
import re
import zlib

import numpy as np

from palisade.llm import toxicity
from palisade.llm.queries_toxicity import op4_toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "lorem ipsum dolor amet sit".split() for b in "abcdefgh"]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randrange(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vilefoo", "vilebar", "nasty"])
        out.append((i, ". ".join(sentences) + ".", int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [(i, t) for i, _, t in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["predicted"] == t for i, t in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    found = toxicity.offending(docs.limit(100), model).collect()
    assert found and all(any(w in r["sentence"] for w in ("vile", "nasty")) for r in found)
    text = dict(r[:2] for r in rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in found)


def test_score_is_noisy_or():
    model = toxicity.train([r[1] for r in corpus(400, 2)], [r[2] for r in corpus(400, 2)])
    for _, text, _ in corpus(40, 3):
        clean = np.prod([1 - p for _, _, p in model.sentences(text)])
        assert abs(model.score(text) - (1 - clean)) < 1e-9


def test_gradient():
    """The gradient against finite differences of the loss."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        doc = np.sort(rng.integers(0, 9, 20))
        bags = toxicity.Bags(rng.integers(0, 20, 60), rng.integers(0, 7, 60), doc, rng.integers(0, 4, 9).astype(float), rng.integers(0, 2, 9).astype(float))
        w, b = rng.normal(size=7), -1.0 + rng.normal()
        _, grad = bags.loss(w, b)
        for i in range(8):
            move = 1e-6 * (np.arange(8) == i)
            up, down = (bags.loss(w + s * move[:7], b + s * move[7])[0] for s in (1, -1))
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-6 * max(1, abs(grad[i]))


def brute(model, text):
    """Noisy-or from the weights alone, sentence by sentence and feature by feature."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        if sentence:
            words = re.findall(r"[^\W\d_]+", sentence)
            held = {x for w in words for x in [w, *(w[:n] + "-" for n in range(3, 8) if n <= len(w))]} & set(model.weights)
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[x] for x in held))))
    return 1 - clean


def test_query(spark, small, tables):
    """The query against a plain version: the same labelled rows, and noisy-or without any shortcut."""
    text = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    marks = {}
    for r in tables["labels"].filter("toxic IS NOT NULL").collect():
        marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["toxic"])
    taught = sorted(i for i in marks if i in text and zlib.crc32(str(i).encode()) % 5)
    assert len(taught) <= toxicity.SAMPLE
    model = toxicity.train([text[i] or "" for i in taught], [marks[i] for i in taught])
    rows = op4_toxicity(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        want = brute(model, text[r["doc_id"]]) if model.weights else 0.0
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_scores_against_brute_force(spark):
    rows = corpus(600, 4)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    assert model.weights and all(abs(got[i] - brute(model, t)) < 1e-9 for i, t, _ in rows)


def test_repeated_ids_teach_by_the_first_text(spark):
    rows = corpus(800, 5)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, "zz vilefoo vilebar nasty.") for i, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert toxicity.fit(docs.repartition(7), labels).weights == toxicity.train([r[1] for r in taught], [r[2] for r in taught]).weights


def test_odd_rows(spark, odd, empty):
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("any") == 0.0
    some = toxicity.fit(odd, spark.createDataFrame([(4, 1), (5, 0), (None, 1), (100, 1)], "doc_id long, toxic int"))
    for model in (none, some):
        assert toxicity.scored(empty, model).count() == 0
        rows = toxicity.scored(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
