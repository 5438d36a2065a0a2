"""A session: runs commands, and holds the variables that they bind.

A selection is bound as a lazy data frame of the selected rows, so fetching from it adds a projection and refining it
adds a predicate to one plan. Variables stay with the version of the table that they were made from; fetching from a
newer version, or pairing vectors of different selections, joins on positions. A join binds the two sides of its pairs,
which keep their order and repeats through `_pair`.

Changes leave a laid-out table in its partitions: a new or changed row carries its part_id, look-ups read the one
partition that can hold the value, and when the changes held are written, only the partitions that they touched are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.comparators import between
from palisade.operators import dml, layout, relational, workload
from palisade.operators.relational import POS
from palisade.plans.catalog import Catalog, CommandError, Table
from palisade.plans.commands import Command, parse
from palisade.sources import csvload, workloads
from palisade.storage import workspace

#: Changes that are held beside a table before it, or the partitions that they touch, are written.
CHANGES = 128
#: Selections that are counted in one scan.
READS = 64
#: The pair that a row of a join's result belongs to.
PAIR = "_pair"


@dataclass(frozen=True)
class Positions:
    """Selected rows; without `whole`, only their positions."""

    table: Table
    version: int
    rows: DataFrame
    whole: bool = True


@dataclass(frozen=True)
class Values:
    rows: DataFrame
    value: Column
    source: Positions | None = None


@dataclass(frozen=True)
class Scalar:
    rows: DataFrame


class Session:
    def __init__(self, spark: SparkSession, data_dir: str = "data", catalog: Catalog | None = None) -> None:
        self.spark, self.data_dir, self.catalog = spark, data_dir, catalog or Catalog(spark)
        self.variables: dict[str, Positions | Values | Scalar] = {}
        self.decisions: dict[str, layout.Layout] = {}
        self.open = True

    def execute(self, line: str) -> DataFrame | None:
        """Run a command; a data frame if it shows something."""
        if not self.open:
            raise CommandError("the session is closed")
        command = parse(line)
        if command is None:
            return None
        return getattr(self, f"_{command.verb}")(command, *command.args)

    def run_script(self, script: str) -> list[DataFrame]:
        """What the commands of a script show, in order."""
        out = []
        for line in script.splitlines():
            shown = self.execute(line) if self.open else None
            if shown is not None:
                out.append(shown)
        return out

    def close(self) -> None:
        self.variables.clear()
        self.open = False

    # -- variables

    def _get(self, name: str, *kinds):
        found = self.variables.get(name)
        if found is None:
            raise CommandError(f"there is no variable {name}")
        if not isinstance(found, kinds):
            raise CommandError(f"{name} can't be used here")
        return found

    def _values(self, name: str) -> Values:
        """A value vector; positions count as values of their own, and a qualified name as the whole column."""
        if "." in name:
            table, column = self.catalog.column(name)
            return Values(table.frame(self.spark), F.col(column))
        found = self._get(name, Positions, Values)
        return Values(found.rows, F.col(POS), found) if isinstance(found, Positions) else found

    # -- definitions

    def _create_db(self, _, name):
        self.catalog.create_db(name)

    def _create_table(self, _, name, db, arity):
        self.catalog.create_table(name, db, arity)

    def _create_column(self, _, name, table, order):
        self.catalog.create_column(name, table, order)

    def _drop_table(self, _, name):
        self.catalog.drop_table(name)

    def _drop_db(self, _, name):
        if name != self.catalog.db:
            raise CommandError(f"there is no database {name}")
        self.catalog.drop_db()
        self.variables.clear()
        self.decisions.clear()

    def _quit(self, _):
        self.close()

    _shutdown = _quit

    def _show_db(self, _):
        return self.catalog.show()

    def _show_table(self, _, name):
        table = self.catalog.column(name)[0] if name not in self.catalog.tables else self.catalog.table(name)
        rows = table.frame(self.spark)
        if table.layout is None:
            rows = rows.withColumn(layout.PART, F.lit(0))
        return layout.shown(rows).orderBy(POS)

    def _load(self, _, path):
        names, rows = csvload.load(self.spark, path)
        tables = {n.rpartition(".")[0] for n in names}
        if len(tables) != 1:
            raise CommandError("a load file fills one table")
        table = self.catalog.table(tables.pop())
        columns = [n.rpartition(".")[2] for n in names]
        if sorted(columns) != sorted(table.columns):
            raise CommandError(f"{table.name} has the columns {table.columns}")
        if table.rows is not None and not table.rows.isEmpty():
            raise CommandError(f"{table.name} has data already")
        rows, order = rows.select(POS, *table.columns), next(iter(table.orders), None)
        if order:  # clustered by the column that was declared sorted, so that statistics of files and row groups prune
            path = workspace(self.spark, "sorted")
            layout.sorted_layout(rows, order).write.parquet(path)
            rows = self.spark.read.parquet(path)
        table.last = None
        table.replace(rows)

    # -- queries

    def _select(self, command: Command, name, low, high):
        table, column = self.catalog.column(name)
        rows = table.frame(self.spark)
        cut = table.layout if table.layout and table.layout.column == column else None
        if low is not None and high == low + 1:
            found = layout.select_first(rows, cut, low) if cut else relational.select_first(rows, column, low)
        else:
            found = layout.select_range(rows, cut, low, high) if cut else relational.select_range(rows, column, low, high)
        self.variables[command.target] = Positions(table, table.version, found)

    def _refine(self, command: Command, one, two, low, high):
        """Accepts values and positions in either order."""
        a, b = self._get(one, Positions, Values), self._get(two, Positions, Values)
        at, vector = (b, a) if isinstance(b, Positions) else (a, b)
        if not isinstance(at, Positions):
            raise CommandError("refining needs positions and values")
        vector = self._values(one) if vector is at else vector
        if vector.rows is at.rows:
            found = relational.refine(at.rows, vector.value, low, high)
        else:
            by = self._key(at, vector)
            found = at.rows.join(relational.refine(vector.rows, vector.value, low, high).select(by), by, "left_semi")
        self.variables[command.target] = Positions(at.table, at.version, found, at.whole)

    def _fetch(self, command: Command, name, positions):
        table, column = self.catalog.column(name)
        at = self._get(positions, Positions)
        if at.table is not table:
            raise CommandError(f"{positions} are positions of {at.table.name}")
        if not at.whole:
            rows = at.rows.join(table.frame(self.spark).select(POS, column), POS)
        elif at.version == table.version:
            rows = at.rows
        else:
            rows = table.frame(self.spark).join(at.rows.select(POS), POS, "left_semi")
        self.variables[command.target] = Values(rows, F.col(column), at)

    @staticmethod
    def _key(*vectors: Positions | Values) -> str:
        """What rows of these are matched by: pairs, if all come from a join, or else positions."""
        return PAIR if all(PAIR in v.rows.columns for v in vectors) else POS

    def _pair(self, one, two) -> tuple[DataFrame, Column, Column]:
        a, b = self._values(one), self._values(two)
        if a.rows is b.rows:
            return a.rows, a.value, b.value
        by = self._key(a, b)
        left, right = (x.rows.select(by, x.value.alias(n)) for x, n in ((a, "_a"), (b, "_b")))
        return left.join(right, by), F.col("_a"), F.col("_b")

    def _add(self, command: Command, one, two):
        rows, a, b = self._pair(one, two)
        self.variables[command.target] = Values(rows, relational.add(a, b))

    def _sub(self, command: Command, one, two):
        rows, a, b = self._pair(one, two)
        self.variables[command.target] = Values(rows, relational.subtract(a, b))

    def _aggregate(self, command: Command, name):
        vector = self._values(name)
        self.variables[command.target] = Scalar(relational.aggregate(vector.rows, command.verb, vector.value))

    _min = _max = _sum = _avg = _count = _aggregate

    def _join(self, command: Command, values1, at1, values2, at2):
        """Positions on both sides of the pairs with equal values, in the order of the first and then of the second."""
        (v1, p1), (v2, p2) = ((self._values(v), self._get(p, Positions)) for v, p in ((values1, at1), (values2, at2)))
        left, right = (v.rows.select(F.col(POS).alias(f"_p{i}"), v.value.alias(f"_v{i}")) for i, v in ((1, v1), (2, v2)))
        both = relational.hash_join(left, right, F.col("_v1") == F.col("_v2")).select("_p1", "_p2", F.struct("_p1", "_p2").alias(PAIR))
        for name, i, p in zip(command.target.split(","), (1, 2), (p1, p2), strict=True):
            self.variables[name] = Positions(p.table, p.version, both.select(F.col(f"_p{i}").alias(POS), PAIR), whole=False)

    def _tuple(self, _, names):
        found = [self._get(n, Positions, Values, Scalar) for n in names]
        if isinstance(found[0], Scalar):
            if len(found) > 1:
                raise CommandError("one scalar is printed at a time")
            return found[0].rows
        vectors = [self._values(n) for n in names]
        by = self._key(*vectors)
        if all(v.rows is vectors[0].rows for v in vectors):
            return relational.printed(vectors[0].rows, *(v.value for v in vectors), by=by)
        rows = vectors[0].rows.select(by, vectors[0].value.alias("_0"))
        for i, v in enumerate(vectors[1:], 1):
            rows = rows.join(v.rows.select(by, v.value.alias(f"_{i}")), by)
        return relational.printed(rows, *(F.col(f"_{i}") for i in range(len(vectors))), by=by)

    # -- changes

    def _part(self, table: Table, values) -> tuple:
        """The part_id, if there is a layout, of a row's values (columns, in order)."""
        return (table.layout.part(values[table.columns.index(table.layout.column)]),) if table.store else ()

    def _hold(self, table: Table, gone: dict[int, tuple], come: dict[int, list]) -> None:
        """Hold rows that go (as they were in the frame) and that come, and write when there are many."""
        extra = {pos: (*row[: len(table.columns)], *self._part(table, row)) for pos, row in come.items()}
        if table.store:
            table.dirty |= {row[-1] for row in (*gone.values(), *extra.values())}
        table.amend(self.spark, gone, extra)
        if len(table.gone) + len(table.extra) >= CHANGES:
            self._write(table, table.rows, table.dirty)

    def _write(self, table: Table, rows: DataFrame, parts: set[int]) -> None:
        """Write the next version: of a laid-out table these partitions, else the whole table."""
        if table.store:
            table.store.write(rows, sorted(parts))
            table.replace(table.store.read(self.spark))
        else:
            path = workspace(self.spark, "version")
            rows.write.parquet(path)
            table.replace(self.spark.read.parquet(path))

    def _plain(self, table: Table) -> DataFrame:
        return table.frame(self.spark).select(POS, *table.columns)

    def _values_for(self, table: Table, values: tuple) -> list:
        if len(values) < len(table.columns) or len(table.columns) < table.arity:
            raise CommandError(f"{table.name} takes {table.arity} values")
        return [*values[: len(table.columns)]]

    def _insert(self, _, name, values):
        table = self.catalog.table(name)
        row = self._values_for(table, values)
        if table.last is None:
            table.last = dml.last_position(table.frame(self.spark))
        table.last += 1
        self._hold(table, {}, {table.last: row})

    def _first(self, table: Table, column: str, value):
        """The first row with a value, looked up in the one partition that can hold it if the layout is by that column."""
        rows, cut = table.frame(self.spark), table.layout
        found = layout.select_first(rows, cut, value) if cut and cut.column == column else relational.select_first(rows, column, value)
        return found.select(POS, *table.columns, *[layout.PART] * bool(cut)).first()

    def _delete(self, _, name, value):
        table, column = self.catalog.column(name)
        if row := self._first(table, column, value):
            self._hold(table, {row[0]: tuple(row)[1:]}, {})

    def _delete_positions(self, _, name, positions):
        table = self.catalog.table(name) if name in self.catalog.tables else self.catalog.column(name)[0]
        rows, at, parts = table.frame(self.spark), self._get(positions, Positions).rows, set()
        if table.store:  # at most one row for each partition
            parts = {r[0] for r in rows.join(at.select(POS), POS, "left_semi").select(layout.PART).distinct().collect()}
        self._write(table, dml.delete_at(rows, at), parts | table.dirty)

    def _update(self, _, name, old, new):
        table, column = self.catalog.column(name)
        if row := self._first(table, column, old):
            changed = [*row[1 : len(table.columns) + 1]]
            changed[table.columns.index(column)] = new
            self._hold(table, {row[0]: tuple(row)[1:]}, {row[0]: changed})

    # -- physical design

    def decide(self, name: str, work: DataFrame, algo: int = 0, **how) -> layout.Layout:
        """Choose a layout for a column and remember it."""
        table, column = self.catalog.column(name)
        self.decisions[name] = workload.decided(self._plain(table), column, work, algo, **how)
        return self.decisions[name]

    def apply(self, name: str, path: str | None = None) -> layout.Layout:
        """Write the table in the layout that was decided, and read it from there from now on."""
        table, _ = self.catalog.column(name)
        if name not in self.decisions:
            raise CommandError(f"nothing has been decided for {name}")
        chosen, plain = self.decisions[name], self._plain(table)
        store = layout.Store(path or workspace(self.spark, "layout"), chosen, plain.schema, next(iter(table.orders), None))
        store.write(layout.assign(plain, chosen))
        table.store = store
        table.replace(store.read(self.spark))
        return chosen

    def part_info(self, name: str) -> DataFrame:
        table, _ = self.catalog.column(name)
        if table.layout is None:
            raise CommandError(f"{table.name} isn't partitioned")
        return layout.info_json(table.frame(self.spark), table.layout)

    def costs(self, name: str, work: DataFrame, bins: int = 256) -> dict[str, float]:
        """Expected rows per read, moves per write and free slots per row under the decided layout."""
        table, column = self.catalog.column(name)
        b, chosen = workload.binned(self._plain(table), column, work, bins), self.decisions[name]
        last = len(b["edges"]) - 1
        ends = sorted({*(next((i for i, e in enumerate(b["edges"]) if e >= p), last) for p in chosen.pivots), last})
        return workload.expected(b, ends, chosen.ghosts if len(chosen.ghosts) == len(ends) else ())

    def satisfy(self, name: str, work: DataFrame, read: float | None = None, update: float | None = None, memory: float | None = None, bins: int = 256) -> dict[str, float]:
        """Decide for the layout, with its free slots, that reads least within bounds on the expected costs; the costs
        that it has."""
        table, column = self.catalog.column(name)
        b = workload.binned(self._plain(table), column, work, bins)
        found = workload.satisfying(b, read, update, memory)
        if found is None:
            raise CommandError("no layout keeps within these bounds")
        self.decisions[name] = layout.Layout(column, tuple(b["edges"][i] for i in found["ends"]), found["ghosts"])
        return {k: found[k] for k in ("read", "update", "memory")}

    def _decide(self, _, name, number, algo):
        self.decide(name, workloads.parsed(self.spark, f"{self.data_dir}/workload{number}"), algo)

    def _partition(self, _, name):
        self.apply(name)

    def _partition_by(self, command, name, number):
        self._decide(command, name, number, 0)
        self.apply(name)

    def _exec_work(self, _, path):
        return self.exec_work(path)

    def exec_work(self, path: str) -> DataFrame:
        """Run a file of commands in their order; (op, seconds, cnt). Selections that follow one another are counted in
        one scan, and writes that follow one another are carried out together, with the results that they have one by
        one; each gets its share of the time."""
        log, run = [], []

        def finish():
            if run:
                began = time.perf_counter()
                (self._read_run if run[0].verb == "select" else self._write_run)(run)
                log.extend((c.verb, (time.perf_counter() - began) / len(run)) for c in run)
                run.clear()

        for row in self.spark.read.text(path).toLocalIterator():
            command = parse(row["value"])
            if command is None:
                continue
            if run and (self._kind(command) is None or not self._follows(run, command)):
                finish()
            if self._kind(command):
                run.append(command)
                continue
            began = time.perf_counter()
            self.execute(row["value"])
            log.append((command.verb, time.perf_counter() - began))
        finish()
        return workload.timings(self.spark.createDataFrame(log, "op string, seconds double"))

    def _kind(self, command: Command) -> tuple | None:
        """("select" or "write", table, column or None) of a command that can be run with others."""
        if command.verb in ("select", "delete", "update"):
            table, column = self.catalog.column(command.args[0])
            return ("select" if command.verb == "select" else "write", table.name, column)
        return ("write", command.args[0], None) if command.verb == "insert" else None

    def _follows(self, run: list[Command], command: Command) -> bool:
        kinds = [self._kind(c) for c in (*run, command)]
        if len({k[:2] for k in kinds}) > 1:
            return False
        return len(run) < READS if kinds[0][0] == "select" else len({k[2] for k in kinds if k[2]}) < 2

    def _read_run(self, run: list[Command]) -> None:
        """Bind the selections and count what they find, in one scan of the partitions that any of them can read."""
        for c in run:
            self._select(c, *c.args)
        table, _ = self.catalog.column(run[0].args[0])
        rows, tests, spans, cut = table.frame(self.spark), [], [], table.layout
        for c in run:
            column, (low, high) = c.args[0].rpartition(".")[2], c.args[1:]
            tests.append(between(F.col(column), low, high) if low is None or high != low + 1 else F.col(column) == low)
            if cut and cut.column == column and (low is None or high is None or low < high):
                spans.append(F.col(layout.PART).between(*cut.span(low, high, False)))
            elif not (cut and cut.column == column):
                spans.append(F.lit(True))
        if cut:
            rows = rows.filter(reduce(or_, spans, F.lit(False)))
        rows.agg(*(F.count(F.when(t, 1)).alias(f"_{i}") for i, t in enumerate(tests))).first()

    def _write_run(self, run: list[Command]) -> None:
        """The writes' effect on the table, as one change."""
        table = self.catalog.table(self._kind(run[0])[1])
        column = next((self._kind(c)[2] for c in run if self._kind(c)[2]), table.columns[0])
        writes = [(c.verb, self._values_for(table, c.args[1])) if c.verb == "insert" else (c.verb, *c.args[1:]) for c in run]
        rows = table.frame(self.spark)
        if table.last is None:
            table.last = dml.last_position(rows)
        near = rows
        if (cut := table.layout) and cut.column == column:  # look-ups read the partitions that can hold the values
            near = rows.filter(F.col(layout.PART).isin(sorted({cut.part(w[1]) for w in writes if w[0] != "insert"})))
        what = dml.effect(near, column, writes, table.last)
        table.last += sum(w[0] == "insert" for w in writes)
        if len(what.gone) + len(what.rows) < CHANGES:
            self._hold(table, what.met, what.rows)
            return
        for pos, row in what.rows.items():
            what.rows[pos] = [*row[: len(table.columns)], *self._part(table, row)]
        parts = {row[-1] for row in (*what.met.values(), *what.rows.values())} if table.store else set()
        self._write(table, dml.applied(rows, what), parts | table.dirty)
