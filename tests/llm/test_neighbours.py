import numpy as np
import pytest

from palisade.llm import neighbours
from palisade.llm.queries_neighbours import op5_neighbours


def brute(vectors, wanted=5):
    """(query, rank) to (id, score) by comparing all."""
    ids = np.array(list(vectors))
    x = np.zeros((len(ids), max(map(len, vectors.values()))))
    for i, v in enumerate(vectors.values()):
        x[i, : len(v)] = np.array(v) / max(map(abs, v))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:wanted]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in w}) / len(w) for q, w in want.items()])


def test_query(spark, small, tables):
    vectors = {r["vec_id"]: list(r["embedding"]) for r in tables["embeddings"].collect()}
    got, want = collected(op5_neighbours(spark, small)), brute(vectors)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, found in got.items():
        for i, s in found:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_recall_with_many_lists(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 48)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) + (8 * rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] if kind == "clusters" else 0)
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    got = collected(neighbours.search(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")))
    want = brute(vectors)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values()) and recall(got, want) >= 0.9


def test_hot_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 3000, 3)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 900, 3)]
    bad = [(5000, None), (5050, [0.0, 0.0, 0.0]), (5100, [1.0, None, 2.0]), (5150, [1.0, float("nan"), 2.0]), (5200, [float("inf"), 1.0, 1.0]), (5250, []), (None, [1.0, 2.0, 3.0])]
    schema = "vec_id long, embedding array<double>, id string, x string, h string"
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows + bad + rows[:40]], schema)
    got, want = collected(neighbours.search(frame)), brute(dict(rows))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_lengths_and_extreme_sizes(spark):
    """Shorter vectors count as padded with zeros; components whose squares don't fit a double take part."""
    rows = [(0, [1.0]), (50, [1e200, 1e200]), (100, [1e-170, 1e-170]), (150, [1e-320, 0.0, 0.0]), (1, [2.0, 1.0, 0.5]), (2, [0.0, 3.0]), (3, [-1e300, 1e-300])]
    got, want = collected(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(dict(rows))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(s - t) < 1e-12 for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_ties(spark):
    """More vectors of one direction than are wanted: the smallest ids win, and no task keeps all of them."""
    rows = [(i, [float(1 << i % 9), float(1 << i % 9)]) for i in range(0, 400)] + [(1000 + i, [1.0, 1.0 + i]) for i in range(1, 50)]
    got = collected(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    got = collected(neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.0, 1.0])], schema)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [50, 7], 50: [0, 7]}


def test_graph_finds_nearest():
    rng = np.random.default_rng(5)
    points = neighbours.units(rng.normal(size=(700, 16)))
    queries = neighbours.units(rng.normal(size=(100, 16)))
    ids, d = neighbours.Graph(points).search(queries, 10)
    want = np.argsort(-(queries @ points.T), axis=1)[:, :10]
    assert (np.diff(d, axis=1) >= 0).all() and np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want, strict=True)]) > 0.9
