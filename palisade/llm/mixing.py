"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Weights are whole numbers w of a total Q. The rows of each source, in a fixed pseudo-random order, are cut into blocks
of `block` size units: a row belongs to the block in which it begins. Block j (from 0) of a source is released at slot
floor(j * Q / w) and due by slot ceil((j + 1) * Q / w); earliest deadline first fills one slot after the other with a
released block. Such unit jobs always meet their deadlines if the weights add up to Q, so at every slot each source is
less than one block ahead of or behind its exact share. All windows repeat after Q slots with nothing left over, so one
frame of Q slots is scheduled, by a fold over its slots, and block j of a source goes to frame floor(j / w).

No row is dropped or repeated: as a source runs out, its later slots stay empty and the others keep their proportions.

Defined cases: a null source, or one without a weight of its own, belongs to the class "*", which takes its own weight;
a null or negative size counts as 0. Rows of a source are ordered by an md5 bucket of the id (of the size, where the id is
null) and then by id and size, so repeated rows follow one another. Rows longer than a block leave later blocks of their source without a row that begins
there. Other columns pass through; one named `mix` is replaced by `mix` and kept by `in_order`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialise

#: Buckets within a source. The table of their sizes has at most BUCKETS x classes rows, whatever the input.
BUCKETS, BLOCK = 4096, 1 << 16
MAX_FRAME = 10_000


def frame(spark, weights: dict[str, int]) -> DataFrame:
    """(class, w, k, at): the k-th block of a class within a frame is at slot `at` of it. The frame has sum(weights) rows."""
    total = sum(weights.values())
    if not 0 < total <= MAX_FRAME or min(weights.values()) < 1 or "*" not in weights:
        raise ValueError(f"weights are whole numbers from 1, add up to at most {MAX_FRAME} and name the class *")
    w = f"array({', '.join(map(str, weights.values()))})"
    names = F.array(*(F.lit(c) for c in weights))
    # of the released blocks of unfinished classes, the one with the earliest deadline; of equals the first class
    ready = f"""filter(transform({w}, (w, i) -> struct((s.done[i] * {total} + {total} + w - 1) div w AS due, CAST(i AS INT) AS i, w AS w)),
                       x -> s.done[x.i] < x.w AND s.done[x.i] * {total} div x.w <= t)"""
    fold = f"""aggregate(sequence(0, {total - 1}),
        named_struct('done', transform({w}, w -> 0L), 'slots', CAST(array() AS ARRAY<INT>)),
        (s, t) -> transform(array(array_min({ready}).i), c -> named_struct(
            'done', transform(s.done, (d, i) -> d + IF(i = c, 1, 0)), 'slots', concat(s.slots, array(c))))[0],
        s -> s.slots)"""
    slots = spark.range(1).select(F.posexplode(F.expr(fold)).alias("at", "c"))
    k = F.row_number().over(Window.partitionBy("c").orderBy("at")) - 1
    return slots.select(F.get(names, F.col("c")).alias("class"), F.expr(f"get({w}, c)").cast("long").alias("w"), k.cast("long").alias("k"), F.col("at").cast("long").alias("at"))


def _bucket(key: Column, size: Column) -> Column:
    named = F.coalesce(key.cast("string"), F.concat(F.lit("size "), size.cast("string")))
    return F.conv(F.substring(F.md5(named), 1, 7), 16, 10).cast("long") % BUCKETS


def _mixed(docs: DataFrame, weights: dict[str, int], size: Column, key: str, source: str, block: int) -> DataFrame:
    """(_row, mix): the row of docs as a struct, and its place."""
    own = [c for c in weights if c != "*"]
    given = F.when(F.col(source).isin(own), F.col(source)).otherwise("*")
    whole = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    docs = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(key).alias("_id"), given.alias("_class"), _bucket(F.col(key), whole).alias("_bucket"), whole.alias("_size"))
    sums = materialise(docs.groupBy("_class", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-sums")
    earlier = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_class", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_class", "_bucket").orderBy("_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("_start", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    rows = rows.join(F.broadcast(sums), ["_class", "_bucket"]).withColumn("_start", F.col("_start") + F.col("_before"))
    rows = rows.withColumn("_block", F.floor(F.col("_start") / block))
    rows = rows.withColumn("_w", F.create_map(*(F.lit(x) for c in weights.items() for x in c))[F.col("_class")].cast("long"))
    total = sum(weights.values())
    slots = frame(docs.sparkSession, weights).select(F.col("class").alias("_class"), F.col("k").alias("_k"), "at")
    rows = rows.withColumn("_k", F.col("_block") % F.col("_w")).join(F.broadcast(slots), ["_class", "_k"])
    mixed = F.struct(
        F.col("_class").alias("class"),
        F.col("_block").alias("block"),
        F.expr(f"_block * {total} div _w").alias("release"),
        F.expr(f"((_block + 1) * {total} + _w - 1) div _w").alias("deadline"),
        F.expr(f"_block div _w * {total} + at").alias("slot"),
        F.col("_start").alias("start"),
    )
    return rows.select("_row", mixed.alias("mix"))


def mix(docs: DataFrame, weights: dict[str, int], size: Column, key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """docs with the struct `mix`: class, block, release, deadline, slot and start (long); sorting by slot and start (the
    size of the source's rows before) gives the mixed order."""
    columns = [c for c in docs.columns if c != "mix"]
    return _mixed(docs, weights, size, key, source, block).select(*(F.col(f"_row.`{c}`") for c in columns), "mix")


def in_order(docs: DataFrame, weights: dict[str, int], size: Column, key: str = "doc_id", source: str = "source", block: int = BLOCK, per_part: int = 256) -> DataFrame:
    """docs without change, dealt to partitions in the mixed order and sorted there. Written as files, each holds the
    next stretch of the schedule, in multiples of per_part slots, so every file has the target weights."""
    rows = _mixed(docs, weights, size, key, source, block)
    rows = rows.repartitionByRange(F.expr(f"mix.slot div {per_part}")).sortWithinPartitions("mix.slot", "mix.start")
    return rows.select("_row.*")
