"""Workloads from files and from generators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.workload import DELETE, INSERT, POINT, RANGE, UPDATE
from palisade.sources.binary import column, write_column

#: Files of a parsed workload, by operation that of num1 and that of num2.
FILES = {POINT: ("pq_cost", None), RANGE: ("rq_cost_beg", "rq_cost_end"), INSERT: ("in_cost", None), UPDATE: ("up_cost_beg", "up_cost_end"), DELETE: ("de_cost", None)}
SCHEMA = "seq long, op int, num1 int, num2 int"


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(seq, val) of a file that begins with the count of its values."""
    return column(spark, path).filter("pos > 0").select((F.col("pos") - 1).alias("seq"), "val")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, op, num1, num2) of the seven files of a parsed workload; seq counts within each operation."""
    parts = []
    for op, (one, two) in FILES.items():
        rows = numbers(spark, f"{folder}/{one}").withColumnRenamed("val", "num1")
        rows = rows.join(numbers(spark, f"{folder}/{two}").withColumnRenamed("val", "num2"), "seq") if two else rows.withColumn("num2", F.lit(0))
        parts.append(rows.select("seq", F.lit(op).alias("op"), "num1", "num2"))
    return reduce(DataFrame.unionByName, parts)


def write_parsed(work: DataFrame, folder: str) -> None:
    """The seven files of a workload."""
    for op, names in FILES.items():
        rows = work.filter(F.col("op") == op)
        head = work.sparkSession.createDataFrame([(-1, n := rows.count(), n)], "pos long, num1 int, num2 int")
        body = head.unionByName(rows.select(F.col("seq").alias("pos"), F.col("num1").cast("int").alias("num1"), F.col("num2").cast("int").alias("num2")))
        for name, of in zip(names, ("num1", "num2"), strict=True):
            if name:
                write_column(body, of, f"{folder}/{name}")


def text(spark: SparkSession, path: str) -> DataFrame:
    """(seq, op, num1, num2) of a file with a command per line."""
    line, number = F.col("value"), r"\s*(-?\d+)\s*"
    got = lambda pattern, i: F.regexp_extract(line, pattern, i)
    select, insert, update, delete = rf"^\s*\w+=s\([^,]+,{number},{number}\)", rf"^\s*i\([^,]+,{number}", rf"^\s*u\([^,]+,{number},{number}\)", rf"^\s*d\([^,]+,{number}\)"
    a = F.coalesce(*(F.when(line.rlike(p), got(p, 1)) for p in (select, insert, update, delete))).cast("int")
    b = F.coalesce(*(F.when(line.rlike(p), got(p, 2)) for p in (select, update))).cast("int")
    op = F.when(line.rlike(select), F.when(b == a + 1, POINT).otherwise(RANGE)).when(line.rlike(insert), INSERT).when(line.rlike(update), UPDATE).when(line.rlike(delete), DELETE)
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), op.alias("op"), a.alias("num1"), b.alias("num2"))
    return rows.filter("op IS NOT NULL").select("seq", "op", "num1", F.coalesce(F.when(F.col("op") == POINT, 0).otherwise(F.col("num2")), F.lit(0)).alias("num2"))


def values(kind: str, domain: int, seed: int) -> Column:
    """Random values in [0, domain): uniform, gauss (mean in the middle, a sixth of the domain as deviation), zipf
    (exponent 1, by its inverse distribution) or beta (2, 5) (the second smallest of six uniform ones)."""
    u = F.rand(seed)
    if kind == "uniform":
        x = u * domain
    elif kind == "gauss":
        x = domain / 2 + F.randn(seed) * (domain / 6)
    elif kind == "zipf":
        x = F.pow(F.lit(float(domain)), u) - 1
    elif kind == "beta":
        x = F.get(F.sort_array(F.array(*(F.rand(seed + i) for i in range(6)))), 1) * domain
    else:
        raise ValueError(kind)
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(domain - 1)).cast("int")


def data(spark: SparkSession, rows: int, columns: int, kind: str = "uniform", domain: int = 1_000_000_000, seed: int = 1) -> DataFrame:
    """(pos, a, b, ...): a is drawn, uniform ones without repeats, and the others are copies of it."""
    base = spark.range(rows).withColumnRenamed("id", "pos")
    if kind == "uniform":  # distinct: a drawn offset within each of `rows` equal steps, in an order scattered by a fixed factor
        step = domain // rows
        if step < 1:
            raise ValueError("more rows than values")
        stride = next(s for s in range(int(rows * 0.618) | 1, 2 * rows + 3, 2) if np.gcd(s, rows) == 1)
        a = (F.col("pos") * stride % rows * step + F.floor(F.rand(seed) * step)).cast("int")
    else:
        a = values(kind, domain, seed)
    base = base.withColumn("a", a)
    names = [chr(ord("a") + i) if i < 26 else "a" + chr(ord("a") + i - 26) for i in range(columns)]
    return base.select("pos", *(F.col("a").alias(n) for n in names))


#: Shares of operations, the width of ranges in the domain, and the distribution of each one's values.
MIX = {POINT: 0.1, RANGE: 0.1, INSERT: 0.266, UPDATE: 0.267, DELETE: 0.267}
WIDTH = 0.01
KINDS = {POINT: "uniform", RANGE: "uniform", INSERT: "beta", UPDATE: "beta", DELETE: "beta"}


def generate(spark: SparkSession, count: int, domain: int, mix: dict[int, float] = MIX, width: float = WIDTH, kinds: dict[int, str] = KINDS, seed: int = 1) -> DataFrame:
    """A random workload."""
    drawn, op = F.col("_u"), F.lit(max(mix))
    for k in sorted(mix, reverse=True):
        op = F.when(drawn < sum(s for o, s in mix.items() if o <= k), k).otherwise(op)
    rows = spark.range(count).select(F.col("id").alias("seq"), F.rand(seed).alias("_u")).withColumn("op", op)
    pick = lambda s: F.coalesce(*(F.when(F.col("op") == k, values(kind, domain, s + k)) for k, kind in kinds.items()))
    rows = rows.withColumn("num1", pick(seed + 10)).withColumn("_new", values(kinds[UPDATE], domain, seed + 50))
    two = F.when(F.col("op") == RANGE, F.col("num1") + int(width * domain)).when(F.col("op") == UPDATE, F.col("_new")).otherwise(0)
    return rows.select("seq", F.col("op").cast("int").alias("op"), "num1", two.cast("int").alias("num2"))


def commands(work: DataFrame, name: str, arity: int) -> DataFrame:
    """(seq, command): a line of the command language per operation."""
    table = name.rpartition(".")[0]
    ones = ",1" * (arity - 1)
    form = {
        POINT: F.concat(F.lit(f"p=s({name},"), "num1", F.lit(","), F.col("num1") + 1, F.lit(")")),
        RANGE: F.concat(F.lit(f"p=s({name},"), "num1", F.lit(","), "num2", F.lit(")")),
        INSERT: F.concat(F.lit(f"i({table},"), "num1", F.lit(f"{ones})")),
        UPDATE: F.concat(F.lit(f"u({name},"), "num1", F.lit(","), "num2", F.lit(")")),
        DELETE: F.concat(F.lit(f"d({name},"), "num1", F.lit(")")),
    }
    return work.select("seq", F.coalesce(*(F.when(F.col("op") == k, x) for k, x in form.items())).alias("command"))

