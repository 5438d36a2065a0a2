"""The database, its tables and their versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegerType, LongType, StructField, StructType

from palisade.operators.layout import PART, Layout, Store
from palisade.operators.relational import POS
from palisade.sources import binary


class CommandError(ValueError):
    """A command that can't be carried out."""


@dataclass
class Table:
    """A table: declared columns and the current version, a data frame (pos, columns) or, with a layout, (pos, columns,
    part_id). Versions are never changed, only replaced.

    A version is what was written last (`base`), without the positions in `gone` and with the rows in `extra`, by
    position; so however many changes are held, they add one filter and one small relation to a plan. With a layout,
    `store` holds the partitions, and `dirty` are those that held changes touch. `last` is the largest position that was
    given out, where it is known: positions aren't given twice.
    """

    name: str
    arity: int
    columns: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    version: int = 0
    orders: dict[str, str] = field(default_factory=dict)
    store: Store | None = None
    last: int | None = None
    base: DataFrame | None = None
    gone: set[int] = field(default_factory=set)
    extra: dict[int, tuple] = field(default_factory=dict)
    dirty: set[int] = field(default_factory=set)

    @property
    def layout(self) -> Layout | None:
        return self.store and self.store.layout

    def schema(self) -> StructType:
        return StructType([StructField(POS, LongType(), False), *(StructField(c, IntegerType()) for c in self.columns)])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema()) if self.rows is None else self.rows

    def replace(self, rows: DataFrame) -> None:
        """A version without held changes."""
        self.rows, self.base, self.version = rows, rows, self.version + 1
        self.gone, self.extra, self.dirty = set(), {}, set()

    def amend(self, spark: SparkSession, gone, extra: dict[int, tuple]) -> None:
        """Hold changes: positions that go, and rows (as in the frame, without pos) that come or take their place."""
        if self.base is None:
            self.base = self.frame(spark)
        for pos in gone:
            if self.extra.pop(pos, None) is None:
                self.gone.add(pos)
        self.extra |= extra
        rows = self.base.filter(~F.col(POS).isin(sorted(self.gone))) if self.gone else self.base
        if self.extra:
            fields = self.base.schema.fields
            fit = [float if isinstance(f.dataType, FractionalType) else lambda v: v for f in fields]
            held = [tuple(None if v is None else g(v) for g, v in zip(fit, (pos, *row), strict=True)) for pos, row in sorted(self.extra.items())]
            rows = rows.unionByName(spark.createDataFrame(held, self.base.schema))
        self.rows, self.version = rows, self.version + 1


class Catalog:
    """One database."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.db, self.tables = spark, None, {}

    def create_db(self, name: str) -> None:
        if self.db is not None:
            raise CommandError(f"there is a database already: {self.db}")
        self.db = name

    def create_table(self, name: str, db: str, arity: int) -> None:
        if db != self.db:
            raise CommandError(f"there is no database {db}")
        if f"{db}.{name}" in self.tables:
            raise CommandError(f"there is a table {db}.{name} already")
        if arity < 1:
            raise CommandError("a table has at least one column")
        self.tables[f"{db}.{name}"] = Table(f"{db}.{name}", arity)

    def create_column(self, name: str, table: str, order: str | None = None) -> None:
        t = self.table(table)
        if len(t.columns) == t.arity:
            raise CommandError(f"{table} has all its {t.arity} columns")
        if name in t.columns or name in (POS, PART):
            raise CommandError(f"{table} can't have another column {name}")
        t.columns.append(name)
        if order in ("sorted", "btree"):
            t.orders[name] = order

    def drop_table(self, name: str) -> None:
        self.table(name)
        del self.tables[name]

    def drop_db(self) -> None:
        self.db, self.tables = None, {}

    def register(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> Table:
        """A table over any data frame with pos; the types of its columns stay."""
        self.db = self.db or name.split(".")[0]
        columns = columns or [c for c in rows.columns if c != POS]
        t = self.tables[name] = Table(name, len(columns), columns, base := rows.select(POS, *columns), base=base)
        return t

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise CommandError(f"there is no table {name}")
        return self.tables[name]

    def column(self, name: str) -> tuple[Table, str]:
        """Table and column of a qualified name, which is split at its last dot."""
        table, _, column = name.rpartition(".")
        t = self.table(table)
        if column not in t.columns:
            raise CommandError(f"there is no column {name}")
        return t, column

    def show(self) -> DataFrame:
        """(db, table, length, column), a row per column; lengths are counted."""
        rows = []
        for t in self.tables.values():
            length = 0 if t.rows is None else t.rows.count()
            rows += [(self.db, t.name.rpartition(".")[2], length, c) for c in t.columns]
        return self.spark.createDataFrame(rows, "db string, table string, length long, column string")

    def save(self, folder: str) -> None:
        """Every table as Parquet, in partition directories if it has a layout, in new folders below this one; then the
        catalog, one JSON line that names them. So a catalog can be saved where it was opened, and until its line is
        written the saved state is the one before. Folders that the line doesn't name any more can be deleted."""
        described = []
        for t in self.tables.values():
            rows, name, laid = t.frame(self.spark), f"{t.name}-{uuid.uuid4().hex}", None
            if t.store:
                saved = Store(f"{folder}/{name}", t.layout, t.store.schema, t.store.sort)
                saved.write(rows)
                laid = {"column": t.layout.column, "pivots": list(t.layout.pivots), "ghosts": list(t.layout.ghosts), "sort": saved.sort, "held": saved.held}
            else:
                rows.write.parquet(f"{folder}/{name}")
            described.append({"name": t.name, "arity": t.arity, "columns": t.columns, "orders": t.orders, "layout": laid, "folder": name, "schema": rows.schema.jsonValue()})
        line = json.dumps({"db": self.db, "tables": described})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/catalog")

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Catalog:
        out, described = Catalog(spark), json.loads(spark.read.text(f"{folder}/catalog").first()["value"])
        out.db = described["db"]
        for x in described["tables"]:
            path, schema = f"{folder}/{x['folder']}", StructType.fromJson(x["schema"])
            t = out.tables[x["name"]] = Table(x["name"], x["arity"], x["columns"], orders=x["orders"])
            if laid := x["layout"]:
                cut = Layout(laid["column"], tuple(laid["pivots"]), tuple(laid["ghosts"]))
                held = {int(i): v for i, v in laid["held"].items()}
                t.store = Store(path, cut, StructType([f for f in schema if f.name != PART]), laid["sort"], held)
            t.rows = t.base = t.store.read(spark) if t.store else spark.read.schema(schema).parquet(path)
        return out

    @staticmethod
    def open_binary(spark: SparkSession, folder: str) -> Catalog:
        """A folder with a dbinfo file and one int32 file per column; nothing is read until a table is used."""
        out, (db, tables) = Catalog(spark), binary.load(spark, folder)
        out.create_db(db)
        for name, rows in tables.items():
            out.register(name, rows)
        return out


def with_positions(rows: DataFrame, key: str) -> DataFrame:
    """rows with pos from a unique key that orders them."""
    return rows.withColumn(POS, F.col(key).cast("long"))
