"""Sharding by best-fit-decreasing bin packing.

Rows with equal group keys form an indivisible group. Groups enter, from the largest to the smallest, the bin with the
tightest remaining capacity that still holds them; a balanced tree (AVL) over the remaining capacities finds it. Groups
of one size are interchangeable, so packing runs over the histogram of group sizes: while the tightest bin takes
another group of the same size it stays the tightest, so a whole run is placed at once, with the very same result. The
histogram has at most sqrt(2 x total size) rows, as distinct sizes add up to at most the total; it alone reaches the
driver. Groups and rows are numbered in distributed cells (size or shard, and a hash bucket) with offsets from the
cells' counts, so neither a hot group nor a hot size lands in one task.

`assign` gives bins of a fixed capacity and opens as few as best fit needs, or spreads all over a fixed number of bins
under the law `bytes`: a group above the mean of what is left gets a bin of its own, then the smallest capacity is
found at which best fit still manages with the bins that are left.

Defined cases: a null text counts as empty; repeated rows and equal texts form one group; a group above the capacity
gets a bin of its own; an empty table gives no rows. Ties between groups of one size go by the hash of their key. Only
the named columns are used, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialise

CELLS, SOME = 4096, 1024


class Tree:
    """AVL tree of (remaining capacity, bin) pairs, held in parallel lists of nodes."""

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.height: list[int] = []
        self.root, self.free = -1, []

    def _h(self, n: int) -> int:
        return self.height[n] if n >= 0 else 0

    def _fix(self, n: int) -> int:
        left, right = self.left, self.right
        lean = self._h(left[n]) - self._h(right[n])
        if lean > 1:
            if self._h(left[left[n]]) < self._h(right[left[n]]):
                left[n] = self._turn(left[n], right, left)
            return self._turn(n, left, right)
        if lean < -1:
            if self._h(right[right[n]]) < self._h(left[right[n]]):
                right[n] = self._turn(right[n], left, right)
            return self._turn(n, right, left)
        self.height[n] = 1 + max(self._h(left[n]), self._h(right[n]))
        return n

    def _turn(self, n: int, up: list[int], down: list[int]) -> int:
        top = up[n]
        up[n], down[top] = down[top], n
        for x in (n, top):
            self.height[x] = 1 + max(self._h(self.left[x]), self._h(self.right[x]))
        return top

    def add(self, key: tuple[int, int]) -> None:
        if self.free:
            new = self.free.pop()
            self.key[new], self.left[new], self.right[new], self.height[new] = key, -1, -1, 1
        else:
            new = len(self.key)
            for xs, x in ((self.key, key), (self.left, -1), (self.right, -1), (self.height, 1)):
                xs.append(x)
        self.root = self._add(self.root, new)

    def _add(self, n: int, new: int) -> int:
        if n < 0:
            return new
        side = self.left if self.key[new] < self.key[n] else self.right
        side[n] = self._add(side[n], new)
        return self._fix(n)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, n: int, key: tuple[int, int]) -> int:
        if key == self.key[n]:
            if self.left[n] < 0 or self.right[n] < 0:
                self.free.append(n)
                return max(self.left[n], self.right[n])
            x = self.right[n]
            while self.left[x] >= 0:
                x = self.left[x]
            following = self.key[x]
            self.right[n] = self._remove(self.right[n], following)
            self.key[n] = following
        else:
            side = self.left if key < self.key[n] else self.right
            side[n] = self._remove(side[n], key)
        return self._fix(n)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest pair whose capacity is at least size."""
        n, best = self.root, None
        while n >= 0:
            if self.key[n][0] >= size:
                best, n = self.key[n], self.left[n]
            else:
                n = self.right[n]
        return best


def best_fit(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, from, to, bin): groups number from..to-1 of that size enter the bin. sizes: (size, count), the largest
    first. Bins are opened as needed, or `bins` are there from the start, and None tells that they don't suffice."""
    tree, runs, opened = Tree(), [], bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for size, count in sizes:
        done = 0
        while done < count:
            room = tree.tightest(size)
            if room is None:
                if bins is not None:
                    return None
                room = (max(capacity, size), opened)
                opened += 1
            else:
                tree.remove(room)
            n = min(count - done, room[0] // size if size else count)
            runs.append((size, done, done + n, room[1]))
            tree.add((room[0] - n * size, room[1]))
            done += n
    return runs


def even(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs as of best_fit, over exactly `bins` bins of nearly equal size."""
    left, total, runs, used, taken = [*sizes], sum(s * n for s, n in sizes), [], 0, 0
    while left and bins - used > 1 and left[0][0] * (bins - used) > total:
        size, n = left[0]
        runs.append((size, taken, taken + 1, used))
        used, total = used + 1, total - size
        left[0], taken = (size, n - 1), taken + 1
        if n == 1:
            left, taken = left[1:], 0
    if left:
        low = max(left[0][0], -(-total // (bins - used))) - 1
        high, found, step = low + 1, None, 1
        while (found := best_fit(left, high, bins - used)) is None:
            low, high, step = high, high + step, step * 2
        while high - low > 1:
            middle = (low + high) // 2
            if (better := best_fit(left, middle, bins - used)) is None:
                low = middle
            else:
                high, found = middle, better
        first = left[0][0]
        runs += [(s, a + taken * (s == first), b + taken * (s == first), used + x) for s, a, b, x in found]
    return runs


def numbered(df: DataFrame, by: str, order: list[str], number: str, cells: int = CELLS) -> DataFrame:
    """df with a gapless number from 0 within each value of `by`, in the order of hash cells and then of `order`."""
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    at = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most `cells` rows for each value of `by`
    offsets = df.groupBy(by, "_cell").agg(F.count("*").alias("_n")).select(by, "_cell", F.coalesce(F.sum("_n").over(at), F.lit(0)).alias("_off"))
    inner = F.row_number().over(Window.partitionBy(by, "_cell").orderBy(*order)) - 1
    return df.withColumn(number, inner.cast("long")).join(offsets, [by, "_cell"]).withColumn(number, F.col(number) + F.col("_off")).drop("_cell", "_off")


def assign(docs: DataFrame, size: Column, group: Column, bins: int | None = None, capacity: int | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `carry`, size, shard and slot (gapless from 0 within a shard) for each row; carry[0] orders the slots."""
    rows = materialise(docs.select(*carry, size.alias("size"), group.alias("_group")), "shard-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    groups = materialise(groups, "shard-groups")
    sizes = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count("*").alias("n")).orderBy(F.desc("_bytes")).toLocalIterator()]
    runs = even(sizes, bins) if bins else best_fit(sizes, capacity)
    spark = docs.sparkSession
    runs = spark.createDataFrame(runs, "_bytes long, _from long, _to long, shard int")
    runs = runs.filter("_from < _to").withColumn("_some", F.explode(F.expr(f"sequence(_from div {SOME}, (_to - 1) div {SOME})")))
    ranked = numbered(groups, "_bytes", ["_group"], "_rank").withColumn("_some", F.expr(f"_rank div {SOME}"))
    # by stretches of ranks, so that each group of a common size meets few of the size's runs
    placed = ranked.join(runs, ["_bytes", "_some"]).filter("_rank >= _from AND _rank < _to")
    placed = materialise(placed.select("_group", "shard"), "shard-placed")
    rows = materialise(rows.join(placed, "_group").drop("_group"), "shard-slots")
    return numbered(rows, "shard", [carry[0], "size"], "slot")
