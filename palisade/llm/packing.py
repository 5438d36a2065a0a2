"""Packing documents into token sequences by cutting-stock column generation.

Each document's token ids are cut at multiples of the sequence length only; whole pieces are sequences of their own, and
documents that fit a sequence stay in one piece. For the program, lengths are rounded up to multiples of UNIT, so the
histogram has at most capacity / UNIT rows whatever the input. On the driver, a linear program over patterns (how many
pieces of each length share a sequence) is solved by the revised simplex method. It starts from the patterns of best-fit
decreasing, of which it takes a basis that needs no more sequences; a knapsack dynamic program over the dual prices,
smoothed towards the best ones known, yields the next pattern, until the solution is within GAP, or one sequence, of the
lower bound, or for a number of steps in proportion to the lengths. Pattern counts are rounded down and what is left is packed by best-fit decreasing. Pieces of each length
are ranked in distributed cells; a piece's rank tells its pattern, the copy of it and the place in it by arithmetic.
Within a sequence, of at most `capacity` pieces, offsets add up the true lengths.

Ids come from a `tokenizers` file. Where a byte-pair ranks file of the same vocabulary is given as well, plain Latin
texts take the faster encoder, which gives the same ids; all other texts, and those that spell a special token, take
`tokenizers`.

Defined cases: a null text counts as empty and gives just the end id; long texts give several pieces; repeated rows are
separate documents; an empty table gives no rows. Pieces of a rounded length are ranked by cell, `order`, key and start. Only the
named columns are used, so other columns can't clash.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import sharding
from palisade.llm.common import by_value, materialise

by_value(__name__)
CAPACITY, END, UNIT, GAP, SMOOTH = 1024, 0, 4, 1e-4, 0.9
#: Rows for which a cell is meant.
CELL = 1 << 16
#: Pre-tokenisation pattern of the byte-level vocabulary, as the ranks file's encoder needs it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]|<\|endoftext\|>")


def encoder(path: str, ranks: str | None):
    """Function from a text to its ids as a uint32 array."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    whole = lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
    if not ranks:
        return whole
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda t: whole(t) if UNUSUAL.search(t) else np.array(fast.encode_ordinary(t), np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where n ids are cut: at multiples of the capacity."""
    ends = [*range(capacity, n, capacity), n]
    return [*zip([0, *ends], ends, strict=False)]


def pieces(docs: DataFrame, path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", order: tuple[str, ...] = (), capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: key, order columns, start, length, ids_crc32, doc_tokens and, if wanted, ids (array of int)."""
    fields = [f for f in docs.select(key, *order).schema]
    keep = [key, *order]

    def cut(batches):
        encode = encoder(path, ranks)
        for pdf in batches:
            at, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, t in enumerate(pdf[text]):
                all_ids = np.append(encode(t), np.uint32(END)) if t else np.array([END], np.uint32)
                for start, end in cuts(len(all_ids), capacity):
                    part = all_ids[start:end]
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                    totals.append(len(all_ids))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            out = pdf[keep].iloc[at].reset_index(drop=True)
            yield out.assign(start=starts, length=lengths, ids_crc32=sums, doc_tokens=totals, **({"ids": ids} if with_ids else {}))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "start long, length long, ids_crc32 long, doc_tokens long"] + ["ids array<int>"] * with_ids)
    return docs.select(*keep, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(cut, schema)


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total price of lengths (ascending), each as often as wanted, within the capacity, and the counts."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = prices[: upto[c]] + best[c - lengths[: upto[c]]]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], take[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(lengths[take[c]])
    return float(best[capacity]), counts


def heuristic(demand: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: patterns, as sorted pairs of length and number, with their counts."""
    bins: dict[int, Counter] = {}
    for size, start, end, b in sharding.best_fit(sorted(((x, n) for x, n in demand.items() if n), reverse=True), capacity):
        bins.setdefault(b, Counter())[size] += end - start
    return Counter(tuple(sorted(p.items())) for p in bins.values())


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps, in plain array operations: the driver needs no threads of a linear algebra
    library, which don't get on with a process that has started others."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        at = i + int(abs(work[i:, i]).argmax())
        if at != i:
            work[[i, at]] = work[[at, i]]
        work[i] /= work[i, i]
        others = np.nonzero(work[:, i])[0]
        others = others[others != i]
        work[others] -= work[others, i, None] * work[i]
    return work[:, n:]


class Basis:
    """A basis of patterns (columns) for the lengths (rows), its inverse, the patterns' counts, and the price that each
    length has in it."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        most = (capacity // lengths).astype(float)
        self.columns, self.inverse, self.amounts, self.prices = np.diag(most), np.diag(1 / most), np.zeros(len(lengths)), 1 / most
        self.row, self.swaps = {int(x): i for i, x in enumerate(lengths)}, 0

    def column(self, pattern) -> np.ndarray:
        out = np.zeros(len(self.row))
        for x, n in pattern:
            out[self.row[x]] = n
        return out

    def change(self, column: np.ndarray) -> np.ndarray:
        """The pattern in terms of the basis."""
        held = np.nonzero(column)[0]
        return (self.inverse[:, held] * column[held]).sum(axis=1)

    def leaving(self, change: np.ndarray) -> tuple[int, float]:
        """(basis column, copies): as copies of a pattern move in, which takes `change` from the basis, the first column
        that falls to zero, and when; of those at the same time the one that changes most, for the sake of precision."""
        ratios = np.full(len(change), np.inf)
        able = change > 1e-7
        ratios[able] = np.maximum(self.amounts[able], 0) / change[able]
        least = ratios.min()
        tied = np.nonzero(ratios <= least + 1e-9)[0]
        return int(tied[change[tied].argmax()]), float(least)

    def enter(self, out: int, copies: float, column: np.ndarray, change: np.ndarray) -> None:
        """So many copies of column take the place of the basis column `out`."""
        self.columns[:, out] = column
        row = self.inverse[out] / change[out]
        self.prices = self.prices + (1 - change.sum()) * row
        self.inverse -= change[:, None] * row
        self.inverse[out] = row
        self.amounts[out] = copies
        self.swaps += 1

    def refresh(self, need: np.ndarray) -> None:
        """Everything afresh, against rounding errors."""
        self.inverse = inverted(self.columns)
        self.prices, self.amounts = self.inverse.sum(axis=0), (self.inverse * need).sum(axis=1)

    def absorb(self, column: np.ndarray, copies: float) -> None:
        """Take over so many copies of a pattern without more sequences than they are: in place of basis patterns if it
        is worth more than they are, else by patterns of the basis, as far as none falls below zero."""
        change = self.change(column)
        sign = 1 if change.sum() > 1 + 1e-9 else -1
        out, move = self.leaving(sign * change)
        if sign < 0 and move >= copies:
            self.amounts = np.maximum(self.amounts + copies * change, 0)
            return
        self.amounts = np.maximum(self.amounts - sign * move * change, 0)
        self.enter(out, copies + sign * move, column, change)


def relaxed(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """(pattern, count) pairs that meet the demand with nearly the fewest sequences, counts not yet whole."""
    lengths = np.array(sorted(demand))
    unit = int(np.gcd.reduce(np.append(lengths, capacity)))
    need = np.array([demand[x] for x in lengths.tolist()], float)
    basis = Basis(lengths, capacity)
    for pattern, copies in heuristic(demand, capacity).items():
        basis.absorb(basis.column(pattern), copies)
    basis.refresh(need)
    inner = lengths / capacity  # prices under which no pattern is worth more than 1: need @ inner is a lower bound
    bound = (need * inner).sum()
    for _ in range(4 * len(lengths) + 100):
        if basis.amounts.sum() <= max(bound * (1 + gap), bound + 1):
            break
        for weight in (SMOOTH, SMOOTH / 2, 0.0):
            mixed = weight * inner + (1 - weight) * basis.prices
            value, column = knapsack(np.maximum(mixed, 0), lengths // unit, capacity // unit)
            if (need * mixed).sum() > bound * value:
                inner = mixed / value
                bound = (need * inner).sum()
            if (column * basis.prices).sum() > 1 + 1e-9:
                break
        else:
            break  # no pattern improves: optimal
        change = basis.change(column)
        out, move = basis.leaving(change)
        basis.amounts = np.maximum(basis.amounts - move * change, 0)
        basis.enter(out, move, column, change)
        if basis.swaps % 200 == 0:
            basis.refresh(need)
    basis.refresh(need)
    return [({int(x): int(n) for x, n in zip(lengths, basis.columns[:, j], strict=True) if n}, float(v)) for j, v in enumerate(basis.amounts) if v > 1e-9]


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(copies, pattern) pairs with whole numbers that place every piece."""
    left, out = Counter({x: n for x, n in demand.items() if n}), []
    if not left:
        return []
    for pattern, amount in relaxed(dict(left), capacity):
        copies = min(int(amount + 1e-6), *(left[x] // n for x, n in pattern.items()))
        if copies > 0:
            out.append((copies, pattern))
            left.subtract({x: n * copies for x, n in pattern.items()})
    return out + [(n, dict(p)) for p, n in heuristic(left, capacity).items()]


def intervals(demand: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, pieces a copy, place): where pieces of a length with those ranks go."""
    out, used, sequence = [], Counter(), 0
    for copies, pattern in plan(demand, capacity):
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            out.append((x, used[x], used[x] + n * copies, sequence, n, offset))
            used[x] += n * copies
            offset += n * x
        sequence += copies
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", order: tuple[str, ...] = (), cell: Column | None = None, unit: int = UNIT) -> DataFrame:
    """The pieces with sequence_id and offset (gapless from 0 in each sequence). cell and order rank the pieces of a
    length; without them the order is that of a hash of the key."""
    cut = materialise(cut, "pieces")
    size = F.least(F.ceil(F.col("length") / unit) * unit, F.lit(capacity)).alias("_size")
    demand = {r["_size"]: r["n"] for r in cut.groupBy(size).agg(F.count("*").alias("n")).collect()}  # at most capacity / unit rows
    if cell is None:  # as many cells as a length has rows for
        dealt = [(x, -(-n // CELL)) for x, n in demand.items() if n > CELL]
        many = F.coalesce(*(F.when(F.col("_size") == x, n) for x, n in dealt), F.lit(1))
        cell = F.pmod(F.xxhash64(key, "start"), many)
    ranked = cut.withColumn("_size", size).withColumn("_cell", cell)
    cells = ranked.groupBy("_size", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialise(cells.select("_size", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "piece-cells")
    whole = demand.pop(capacity, 0)
    table = [(capacity, 0, whole, 0, 1, 0)] + [(x, a, b, s + whole, n, o) for x, a, b, s, n, o in intervals(demand, capacity)]
    places = cut.sparkSession.createDataFrame(table, "_size long, _from long, _to long, _first long, _each long, _at long")
    rank = F.row_number().over(Window.partitionBy("_size", "_cell").orderBy(*order, key, "start")) - 1
    ranked = ranked.withColumn("_rank", rank).join(cells, ["_size", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_off"))
    # the table of patterns is bounded by the number of lengths, not by the input
    placed = ranked.join(F.broadcast(places), "_size").filter("_rank >= _from AND _rank < _to")
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each")).withColumn("_at", F.expr("_at + (_rank - _from) % _each * _size"))
    within = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, ids) of pieces with ids: padded with `end` to the capacity unless the length is a power of two."""
    parts = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    joined = packed.groupBy("sequence_id").agg(parts.alias("ids"))  # at most `capacity` ids in a group
    power = F.bit_count(F.size("ids")) == 1
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(end), F.lit(capacity) - F.size("ids")))).alias("ids"))
