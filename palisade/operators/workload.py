"""Histories of operations: histograms, the partition decision, and timings.

A workload is a data frame (seq, op, num1, num2): op is 0 point, 1 range, 2 insert, 3 update, 4 delete; num1 is the
value, the begin of the range or the old value, num2 the end of the range or the new value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.lookup import partition_of
from palisade.operators.layout import Layout, equal_depth, equal_width, tiles

#: Codes of operations; values for each bucket of a histogram, and the number of buckets.
POINT, RANGE, INSERT, UPDATE, DELETE = range(5)
BUCKET, BUCKETS = 10_000, 100_000
MAX_BINS = 1000


def histogram(work: DataFrame) -> DataFrame:
    """(op, bucket, cnt). Ranges and updates count in every bucket from num1's to num2's; backward ones in none. The
    buckets are summed as steps up and down and then prefix-summed, so a wide range costs two rows and not thousands."""
    slot = lambda c: F.least(F.greatest(F.expr(f"{c} div {BUCKET}"), F.lit(0)), F.lit(BUCKETS - 1))
    wide = F.col("op").isin(RANGE, UPDATE)
    ends = work.select("op", slot("num1").alias("lo"), F.when(wide, slot("num2")).otherwise(slot("num1")).alias("hi")).filter("lo <= hi")
    step = lambda at, d: F.struct(at.alias("bucket"), F.lit(d).alias("d"))
    steps = ends.select("op", F.explode(F.array(step(F.col("lo"), 1), step(F.col("hi") + 1, -1))).alias("s")).select("op", "s.*")
    steps = steps.groupBy("op", "bucket").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("op").orderBy("bucket")  # at most BUCKETS + 1 rows for each op
    flat = steps.withColumn("cnt", F.sum("d").over(by)).withColumn("next", F.lead("bucket").over(by)).filter("cnt > 0")
    return flat.select("op", F.explode(F.sequence("bucket", F.col("next") - 1)).alias("bucket"), "cnt")


def op_mix(work: DataFrame) -> DataFrame:
    """(op, cnt)."""
    return work.groupBy("op").agg(F.count("*").alias("cnt"))


def binned(table: DataFrame, column: str, work: DataFrame, bins: int) -> dict:
    """What the decision needs, at most bins x bins numbers: the bins' upper values, rows per bin, and how often each
    operation falls on each bin or pair of bins. Bins are the exact quantiles of the column."""
    edges = sorted({int(r["pivot"]) for r in tiles(table.filter(F.col(column).isNotNull()), column, bins).collect()}) or [0]
    bin_of = lambda c: partition_of(c, edges)
    rows = table.groupBy(bin_of(F.col(column)).alias("b")).count().collect()
    other = F.when(F.col("op") == RANGE, F.col("num2") - 1).when(F.col("op") == UPDATE, F.col("num2")).otherwise(F.col("num1"))
    pairs = work.withColumn("_other", other).groupBy("op", bin_of(F.col("num1")).alias("a"), bin_of(F.col("_other")).alias("b")).count().collect()
    out = {"edges": edges, "rows": np.zeros(len(edges)), **{op: np.zeros((len(edges), len(edges))) for op in range(5)}}
    for r in rows:
        out["rows"][r["b"]] = r["count"]
    for r in pairs:
        if r["op"] == UPDATE or r["op"] in out and r["a"] <= r["b"]:
            out[r["op"]][r["a"], r["b"]] = r["count"]
    return out


def decide(b: dict, max_parts: int | None = None, read_weight: float = 1.0, write_weight: float = 1.0) -> tuple[list[int], float]:
    """(indices of the bins that end partitions, cost) with the least cost of all layouts whose pivots end bins, under
    this model, by dynamic programming:

    a point query reads its partition; a range reads its first and last partition; an insert moves one row in each
    partition behind its own; a delete reads its partition and does the same; an update reads the old value's partition
    and moves one row in each partition between the old and the new one.
    """
    n = len(b["edges"])
    rows = np.concatenate(([0], b["rows"].cumsum()))
    diagonal = lambda op: b[op].sum(axis=1)
    heads = read_weight * (diagonal(POINT) + b[RANGE].sum(axis=1) + b[RANGE].sum(axis=0)) + write_weight * (diagonal(DELETE) + diagonal(UPDATE))
    touched = np.concatenate(([0], heads.cumsum()))
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = b[RANGE].cumsum(axis=0).cumsum(axis=1)
    behind = np.concatenate(([0], write_weight * (diagonal(INSERT) + diagonal(DELETE)).cumsum()))
    crossing = np.zeros(n + 1)
    for j in range(1, n):  # updates with one end before boundary j and one behind it
        crossing[j] = write_weight * (b[UPDATE][:j, j:].sum() + b[UPDATE][j:, :j].sum())
    best, origin = [np.full(n + 1, np.inf)], []
    best[0][0] = 0
    limit, whole = min(max_parts or n, n), np.full(n + 1, np.inf)  # without a limit, partitions need not be counted

    def reach(f, j):
        i = np.arange(j)
        once = area[j, j] - area[i, j] - area[j, i] + area[i, i]  # ranges inside are read once, not twice
        cost = (rows[j] - rows[i]) * (touched[j] - touched[i] - read_weight * once) + np.where(i > 0, behind[i] + crossing[i], 0)
        total = f[:j] + cost
        k = int(total.argmin())
        return total[k], k

    whole[0], back = 0, np.zeros(n + 1, int)
    for j in range(1, n + 1):
        whole[j], back[j] = reach(whole, j)
    ends, j = [], n
    while j > 0:
        ends.append(j - 1)
        j = back[j]
    if len(ends) <= limit:  # the best of all layouts is within the limit
        return ends[::-1], float(whole[n])
    for k in range(limit):
        f, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(k + 1, n + 1):
            f[j], back[j] = reach(best[k], j)
        best.append(f)
        origin.append(back)
    k = int(np.argmin([f[n] for f in best]))
    cost, ends, j = float(best[k][n]), [], n
    while k > 0:
        ends.append(j - 1)
        j = origin[k - 1][j]
        k -= 1
    return ends[::-1], cost


def decided(table: DataFrame, column: str, work: DataFrame, algo: int = 0, parts: int = 16, bins: int = 256, max_parts: int | None = None) -> Layout:
    """Layout by algorithm: 0 least cost, 1 equal depth, 2 equal width, 4 no partitions, 5 sorted (a partition per bin)."""
    if not 0 < bins <= MAX_BINS:
        raise ValueError(f"bins: 1 to {MAX_BINS}")
    if algo == 0:
        b = binned(table, column, work, bins)
        ends, _ = decide(b, max_parts)
        return Layout(column, tuple(b["edges"][i] for i in ends))
    if algo == 2:
        return equal_width(table, column, parts)
    if algo in (1, 4, 5):
        return equal_depth(table, column, {1: parts, 4: 1, 5: bins}[algo])
    raise ValueError(f"there is no algorithm {algo}")


def _arrivals(b: dict, ends: list[int]) -> np.ndarray:
    """Rows that inserts and updates bring to each partition."""
    part = np.searchsorted(np.array(ends), np.arange(len(b["edges"])))
    stay = part[:, None] == part[None, :]
    come = b[INSERT].sum(axis=1) + (b[UPDATE] * ~stay).sum(axis=0)
    return np.bincount(part, come, len(ends))


def ghosts(b: dict, ends: list[int], slots: int) -> tuple[int, ...]:
    """Free slots of each partition: shares of `slots` by the rows that are expected to come there (largest remainders)."""
    come = _arrivals(b, ends)
    share = slots * (come / come.sum() if come.sum() else np.full(len(ends), 1 / len(ends)))
    out = np.floor(share)
    out[np.argsort(out - share, kind="stable")[: int(slots - out.sum())]] += 1
    return tuple(int(x) for x in out)


def expected(b: dict, ends: list[int], free: tuple[int, ...] = ()) -> dict[str, float]:
    """Rows read per read operation, moves per write operation and free slots per row (read, update, memory). A row that
    finds a free slot in its partition moves no other one."""
    n, bounds = len(b["edges"]), [0, *(e + 1 for e in ends)]
    part = np.searchsorted(np.array(ends), np.arange(n))
    size = np.array([b["rows"][i:j].sum() for i, j in zip(bounds, bounds[1:], strict=False)])
    i, j = np.indices((n, n))
    ranges = size[part[i]] + np.where(part[i] != part[j], size[part[j]], 0)
    reads = (b[POINT] * size[part[i]]).sum() + (b[RANGE] * ranges).sum()
    come = _arrivals(b, ends)
    crowded = 1 - np.minimum(1, np.array(free or (0,) * len(ends)) / np.maximum(come, 1))  # share that finds no slot
    behind = len(ends) - 1 - part[i]
    moves = (b[INSERT] * behind * crowded[part[i]]).sum() + (b[DELETE] * behind).sum() + (b[UPDATE] * abs(part[i] - part[j]) * crowded[part[j]]).sum()
    n_reads, n_writes = (b[POINT] + b[RANGE]).sum(), (b[INSERT] + b[DELETE] + b[UPDATE]).sum()
    return {"read": float(reads / max(1, n_reads)), "update": float(moves / max(1, n_writes)), "memory": float(sum(free) / max(1, b["rows"].sum()))}


def trade_offs(b: dict, weights: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), shares: tuple[float, ...] = (0.0, 0.001, 0.01, 0.1)) -> list[dict]:
    """Layouts that are best for some weight of writes against reads, or with so few partitions, with some free slots for
    each row: their ends, ghosts and expected read, update and memory costs."""
    ways, k = [(None, w) for w in weights], 1
    while k < len(b["edges"]):
        ways.append((k, 1.0))
        k *= 2
    out, seen = [], set()
    for most, weight in ways:
        ends, _ = decide(b, most, 1.0, weight)
        for share in shares:
            free = ghosts(b, ends, int(share * b["rows"].sum()))
            if (key := (tuple(ends), free)) not in seen:
                seen.add(key)
                out.append({"ends": ends, "ghosts": free, **expected(b, ends, free)})
    return out


def satisfying(b: dict, read: float | None = None, update: float | None = None, memory: float | None = None) -> dict | None:
    """Of the trade-offs within these bounds on read, update and memory costs, the one that reads least (then updates
    least, then takes least memory); None if there is none."""
    limits = {"read": read, "update": update, "memory": memory}
    fit = [x for x in trade_offs(b) if all(v is None or x[k] <= v for k, v in limits.items())]
    return min(fit, key=lambda x: (x["read"], x["update"], x["memory"]), default=None)


def timings(log: DataFrame) -> DataFrame:
    """(op, seconds, cnt) of a replay log (op, seconds)."""
    return log.groupBy("op").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("cnt"))
