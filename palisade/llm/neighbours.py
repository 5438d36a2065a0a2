"""Approximate nearest neighbours by balanced posting lists.

Equal vectors are merged first; of their ids only the smallest few can be results, as ties go to the smaller id, so a
hot vector costs no more than any other. Centroids come from halving a bounded sample again and again at the median
along the line between two means, which gives lists of equal size. A graph over the centroids (their nearest ones and
some random ones), held in memory by each task, is searched best first with a beam. A vector enters the nearest list
and, as boundary vector, each further one within NEAR times that distance, up to COPIES lists. A query reads the lists
within FAR times the distance of its nearest centroid, up to a share of all lists, and more until enough vectors are
certain. Lists larger than CHUNK vectors, or asked by more than CHUNK queries, are split into parts of that size.
Similarities are computed in double precision on the original vectors, each scaled by its largest component first, so
that no norm over- or underflows.

The sample and the number of lists are bounded (SAMPLE, LISTS); every vector is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths are compared as if the shorter ended in zeros; equal vectors under one id count once, and different ones are rows
of their own; with fewer candidates than wanted all are returned; ties in score go to the smaller id; an empty table gives no
rows. Only id and vector are used, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import by_value, materialise

by_value(__name__)
SAMPLE, LISTS, LIST = 100_000, 16_384, 200
COPIES, NEAR, FAR, PROBES, SHARE = 2, 1.3, 1.5, 24, 0.3
DEGREE, LONG, BEAM, CHUNK = 16, 4, 48, 4096


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, as squares of very large or small ones don't fit."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of `lists` (a power of two, or fewer) parts of equal size."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(sample))]
    while len(parts) < lists:
        halves = []
        for part in parts:
            x = sample[part]
            if len(part) < 2:
                halves.append(part)
                continue
            a, b = x[rng.choice(len(part), 2, replace=False)]
            for _ in range(6):
                side = x @ (a - b)
                upper = side > np.median(side)
                if not upper.any() or upper.all():
                    break
                a, b = x[upper].mean(0), x[~upper].mean(0)
            order = np.argsort(x @ (a - b), kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        if len(halves) == len(parts):
            break
        parts = halves
    means = np.vstack([sample[p].mean(0) for p in parts])
    return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)


class Graph:
    """Neighbour graph over unit centroids with beam search, for many queries at a time."""

    def __init__(self, points: np.ndarray, seed: int = 7) -> None:
        n = len(points)
        self.points = points
        near = np.vstack([np.argsort(-(points[i : i + 512] @ points.T), axis=1)[:, 1 : DEGREE + 1] for i in range(0, n, 512)])
        far = np.random.default_rng(seed).integers(0, n, (n, LONG))
        ring = (np.arange(n)[:, None] + 1) % n  # so that every centroid can be reached
        self.links = np.hstack([near, far, ring])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, BEAM)).astype(int))

    @staticmethod
    def of(points: np.ndarray, links: np.ndarray, entries: np.ndarray) -> Graph:
        """A graph that was built elsewhere; only its arrays are sent to executors."""
        out = Graph.__new__(Graph)
        out.points, out.links, out.entries = points, links, entries
        return out

    def search(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, of about the `wanted` nearest centroids of each query."""
        width = min(max(BEAM, wanted), len(self.points))
        found, distances = [], []
        for at in range(0, len(queries), 64):
            ids, d = self._beam(queries[at : at + 64], width)
            found.append(ids[:, :wanted])
            distances.append(d[:, :wanted])
        return np.vstack(found), np.vstack(distances)

    def _beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(self.points), np.arange(len(q))[:, None]
        distance = np.full((len(q), n), np.inf)  # of the centroids reached so far
        opened = np.zeros((len(q), n), bool)

        def reach(ids):
            dots = np.einsum("qd,qkd->qk", q, self.points[ids])
            distance[rows, ids] = np.sqrt(np.maximum(0, 2 - 2 * dots))

        reach(np.broadcast_to(self.entries, (len(q), len(self.entries))))
        while True:
            best = np.argpartition(distance, width - 1, axis=1)[:, :width] if width < n else np.broadcast_to(np.arange(n), (len(q), n))
            todo = np.where(np.isfinite(distance[rows, best]) & ~opened[rows, best], distance[rows, best], np.inf)
            if not np.isfinite(todo).any():
                break
            step = min(8, width)
            pick = np.argpartition(todo, step - 1, axis=1)[:, :step]
            front = best[rows, pick]
            opened[rows, front] |= np.isfinite(todo[rows, pick])
            reach(self.links[front].reshape(len(q), -1))
        order = np.argsort(distance[rows, best], axis=1, kind="stable")
        ids = best[rows, order]
        return ids, distance[rows, ids]


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def search(vectors: DataFrame, wanted: int = 5, is_query: str = "vec_id % 50 = 0", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for each row that is a query, itself left out."""
    spark, keep = vectors.sparkSession, wanted + 1
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), F.expr(is_query.replace("vec_id", key)).alias("q"))
    rows = rows.filter(valid(F.col("x")) & F.col("id").isNotNull())
    half = lambda x: F.lpad(F.hex(F.xxhash64(x)), 16, "0")
    rows = materialise(rows.withColumn("h", F.concat(half("x"), half(F.reverse("x")))), "vectors")
    first = [F.first("x").alias("x"), F.min("id").alias("id"), F.count("*").alias("n"), F.max(F.coalesce("q", F.lit(False))).alias("q")]
    distinct = materialise(rows.groupBy("h").agg(*first), "vector-classes")
    n, width = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(LISTS, 2 ** max(0, np.round(np.log2(n / LIST)))))
    part = distinct.select("h", "x")
    if n > SAMPLE:  # hashes: a random sample, of which tasks send no more than their share
        part = part.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(1.2 * SAMPLE / n * (1 << 20)) + 1).orderBy("h").limit(SAMPLE)
    points = centroids(units(_matrix(part.select("x").toPandas()["x"], width)), lists)
    built = Graph(points)
    shared = spark.sparkContext.broadcast((built.points, built.links, built.entries))  # at most LISTS centroids
    number, kind = len(points), distinct.schema["x"].dataType.simpleString()

    def post(batches):
        graph = Graph.of(*shared.value)
        for pdf in batches:
            found, d = graph.search(units(_matrix(pdf["x"], width)), min(COPIES, number))
            r, c = np.nonzero(d <= np.maximum(d[:, :1] * NEAR, d[:, :1] + 1e-12))
            yield pd.DataFrame({"list": found[r, c], "h": pdf["h"].to_numpy()[r], "id": pdf["id"].to_numpy()[r], "x": pdf["x"].to_numpy()[r]})

    posts = materialise(distinct.select("h", "id", "x").mapInPandas(post, f"list int, h string, id long, x {kind}"), "postings")
    sizes = {r["list"]: r["n"] for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    held = np.array([sizes.get(i, 0) for i in range(number)])
    probes = min(number, max(PROBES, int(number * SHARE)))

    def ask(batches):
        graph = Graph.of(*shared.value)
        for pdf in batches:
            found, d = graph.search(units(_matrix(pdf["x"], width)), number if held.sum() < COPIES * keep else probes)
            sure = np.cumsum(held[found], axis=1) - held[found] < COPIES * keep  # so far perhaps fewer vectors than wanted
            r, c = np.nonzero((d <= d[:, :1] * FAR) | sure)
            yield pd.DataFrame({"list": found[r, c], "h": pdf["h"].to_numpy()[r], "x": pdf["x"].to_numpy()[r]})

    asked = materialise(distinct.filter("q").select("h", "x").mapInPandas(ask, f"list int, h string, x {kind}"), "probes")
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = [-(-int(x) // CHUNK) or 1 for x in held]
    turns = [-(-int(asks.get(i, 0)) // CHUNK) or 1 for i in range(number)]
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("list"))
    hashed = F.pmod(F.xxhash64("h"), F.lit(1 << 30)).cast("int")
    every = lambda xs: F.explode(F.sequence(F.lit(0), at(xs) - 1))
    left = asked.withColumn("turn", hashed % at(turns)).withColumn("part", every(parts))
    right = posts.withColumn("part", hashed % at(parts)).withColumn("turn", every(turns))

    def nearest(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        names, parts = ("q", "h", "id", "score"), [(np.empty(0, object), np.empty(0, object), np.empty(0, np.int64), np.empty(0))]
        if len(qs) and len(vs):
            a, b = units(_matrix(qs["x"], width)), units(_matrix(vs["x"], width))
            order = np.argsort(vs["id"].to_numpy(), kind="stable")  # so that of ties the smaller ids come first
            b, asked_by, hs, ids = b[order], qs["h"].to_numpy(object), vs["h"].to_numpy(object)[order], vs["id"].to_numpy()[order]
            for i in range(0, len(a), 256):
                s = a[i : i + 256] @ b.T
                c = np.argsort(-s, axis=1, kind="stable")[:, :keep] if s.shape[1] <= 4 * keep else _top(s, keep)
                r = np.repeat(np.arange(len(s)), c.shape[1])
                parts.append((asked_by[i + r], hs[c.ravel()], ids[c.ravel()], s[r, c.ravel()]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)})

    key_of = ["list", "part", "turn"]
    pairs = left.groupBy(*key_of).cogroup(right.groupBy(*key_of)).applyInPandas(nearest, "q string, h string, id long, score double")
    pairs = pairs.groupBy("q", "h", "id").agg(F.max("score").alias("score"))
    # the classes with the best scores, of equal ones those with the smallest ids, hold all results
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    close = materialise(pairs.withColumn("k", best).filter(F.col("k") <= keep).drop("k"), "nearest")
    others = distinct.filter("n > 1").select("h").join(close.select("h").distinct(), "h", "left_semi")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("id"))  # limited before the shuffle as well
    more = rows.join(others, "h", "left_semi").select("h", "id").distinct().withColumn("r", rank).filter(f"r > 1 AND r <= {keep}")
    more = close.select("q", "h", "score").join(more.select("h", "id"), "h")
    near = close.select("q", "id", "score").unionByName(more.select("q", "id", "score"))
    queries = rows.filter("q").select(F.col("id").alias("query_id"), F.col("h").alias("q")).distinct()
    near = queries.join(near.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")).alias("near")), "q")  # at most keep * keep in a group
    ranked = F.slice(F.filter(F.array_sort("near"), lambda v: v["id"] != F.col("query_id")), 1, wanted)
    out = near.select("query_id", F.posexplode(ranked).alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def _top(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` largest values of each row, the first ones of equal values."""
    cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep][:, None]
    above, equal = s > cut, s == cut
    spare = keep - above.sum(axis=1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= spare))
    return np.nonzero(chosen)[1].reshape(len(s), keep)
