"""A query for each operator over the shared test tables, and SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.comparators import EQUAL, GREATER, LESS
from palisade.operators import dml, layout, relational, workload
from palisade.operators.layout import PART, Layout
from palisade.operators.relational import POS
from palisade.plans.catalog import Catalog, with_positions
from palisade.session import Session
from palisade.sources import binary, csvload, workloads
from palisade.storage import workspace

LOW, HIGH, POINT = 100, 300, 42
PIVOTS = Layout("o_custkey", (100, 250, 400, 700, 1100, 1499))
CASE = " ".join(f"WHEN o_custkey <= {p} THEN {i}" for i, p in enumerate(PIVOTS.pivots[:-1]))
PARTED = f"(SELECT o_orderkey AS pos, o_custkey, o_totalprice, CASE {CASE} ELSE {len(PIVOTS.pivots) - 1} END AS part_id FROM orders)"
#: Operations made from events: op, num1, num2.
OPS = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
WORK_SQL = f"""SELECT event_id AS seq, CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in OPS.items())} END AS INT) AS op,
  user_id * 6000 + event_id % 6000 AS num1,
  CASE event_type WHEN 'click' THEN user_id * 6000 + event_id % 6000 + 25000 WHEN 'purchase' THEN user_id * 7 % 150 * 6000 ELSE 0 END AS num2 FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(table(spark, sf_dir, "orders"), "o_orderkey")


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assign(orders(spark, sf_dir), PIVOTS).select(POS, "o_custkey", "o_totalprice", PART)


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "parted")
    layout.write(orders(spark, sf_dir).select(POS, "o_custkey", "o_totalprice"), PIVOTS, path)
    return layout.read(spark, path)


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in OPS.items())).cast("int")
    one = F.expr("user_id * 6000 + event_id % 6000")
    two = F.when(F.col("event_type") == "click", one + 25000).when(F.col("event_type") == "purchase", F.expr("user_id * 7 % 150 * 6000")).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), one.alias("num1"), two.alias("num2"))


def session(spark: SparkSession, sf_dir: str) -> Session:
    catalog = Catalog(spark)
    catalog.register("db.orders", orders(spark, sf_dir))
    catalog.register("db.lineitem", with_positions(table(spark, sf_dir, "lineitem"), "l_orderkey"))
    return Session(spark, sf_dir, catalog)


def script(text: str):
    """A query that runs commands and returns what the last one shows."""
    return lambda spark, sf_dir: session(spark, sf_dir).run_script(text)[-1]


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


SELECTED = f"FROM orders WHERE o_custkey >= {LOW} AND o_custkey < {HIGH}"
chosen = lambda s, d: relational.select_range(orders(s, d), "o_custkey", LOW, HIGH)

query("flagship", f"SELECT o_totalprice AS val {SELECTED}")(script(f"p=s(db.orders.o_custkey,{LOW},{HIGH})\nf=fetch(db.orders.o_totalprice,p)\ntuple(f)"))
query("range_select", f"SELECT o_orderkey AS pos {SELECTED}")(lambda s, d: relational.positions(chosen(s, d)))
query("range_open_low", f"SELECT o_orderkey AS pos FROM orders WHERE o_custkey < {HIGH}")(lambda s, d: relational.positions(relational.select_range(orders(s, d), "o_custkey", None, HIGH)))
query("range_open_high", f"SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= {HIGH}")(lambda s, d: relational.positions(relational.select_range(orders(s, d), "o_custkey", HIGH, None)))
query("range_inverted", f"SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= {HIGH} AND o_custkey < {LOW}")(lambda s, d: relational.positions(relational.select_range(orders(s, d), "o_custkey", HIGH, LOW)))
query("point_select_first", f"SELECT o_orderkey AS pos FROM orders WHERE o_custkey = {POINT} ORDER BY o_orderkey LIMIT 1")(lambda s, d: relational.positions(relational.select_first(orders(s, d), "o_custkey", POINT)))
query("refine_select", f"SELECT o_orderkey AS pos {SELECTED} AND o_totalprice >= 1000 AND o_totalprice < 90000")(lambda s, d: relational.positions(relational.refine(chosen(s, d), F.col("o_totalprice"), 1000, 90000)))
query("refine_by_commands", f"SELECT o_orderkey AS val {SELECTED} AND o_totalprice >= 1000 AND o_totalprice < 90000")(
    script(f"s1=select(db.orders.o_custkey,{LOW},{HIGH})\nf1=fetch(db.orders.o_totalprice,s1)\ns2=select(s1,f1,1000,90000)\ntuple(s2)")
)
query("comparator_chain", "SELECT o_orderkey AS pos FROM orders WHERE (((o_custkey < 10 OR o_custkey > 1200) AND o_custkey <= 1300) OR o_custkey = 600)")(
    lambda s, d: relational.positions(relational.select_where(orders(s, d), "o_custkey", [(None, LESS, 10), ("or", GREATER, 1200), ("and", LESS | EQUAL, 1300), ("or", EQUAL, 600)]))
)
query("full_scan_chain", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= 7 AND o_custkey < 9")(lambda s, d: relational.positions(relational.select_where(orders(s, d), "o_custkey", [(None, GREATER | EQUAL, 7), ("and", LESS, 9)])))
query("fetch_values", f"SELECT o_orderkey AS pos, o_totalprice AS val {SELECTED}")(lambda s, d: relational.fetch(chosen(s, d), "o_totalprice"))
query("fetch_at_positions", f"SELECT o_orderkey AS pos, o_totalprice AS val {SELECTED}")(lambda s, d: relational.fetch_at(orders(s, d), relational.positions(chosen(s, d)), "o_totalprice"))
query("fetch_tuple", f"SELECT o_totalprice AS val {SELECTED}")(lambda s, d: relational.printed(chosen(s, d), F.col("o_totalprice")))
query("tuple_columns", f"SELECT o_custkey AS val0, o_totalprice AS val1 {SELECTED}")(
    script(f"p=s(db.orders.o_custkey,{LOW},{HIGH})\na=fetch(db.orders.o_custkey,p)\nb=fetch(db.orders.o_totalprice,p)\ntuple(a,b)")
)
query("project_columns", "SELECT o_custkey, o_totalprice FROM orders")(lambda s, d: table(s, d, "orders").select("o_custkey", "o_totalprice"))
for _kind in ("min", "max", "sum", "avg", "count"):
    _cast = {"sum": "CAST(sum(o_custkey) AS BIGINT)"}.get(_kind, f"{_kind}(o_custkey)")
    query(f"agg_{_kind}", f"SELECT {_cast} AS val {SELECTED}")(lambda s, d, k=_kind: relational.aggregate(chosen(s, d), k, F.col("o_custkey")))
query("avg_whole_column", "SELECT avg(o_custkey) AS val FROM orders")(script("a=avg(db.orders.o_custkey)\ntuple(a)"))
_LINES = "FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20"
for _name, _op, _sign in (("vec_add", "add", "+"), ("vec_sub", "sub", "-")):
    query(_name, f"SELECT CAST(l_partkey AS BIGINT) {_sign} CAST(l_suppkey AS BIGINT) AS val {_LINES}")(
        script(f"s1=select(db.lineitem.l_quantity,10,20)\nf1=fetch(db.lineitem.l_partkey,s1)\nf2=fetch(db.lineitem.l_suppkey,s1)\na={_op}(f1,f2)\ntuple(a)")
    )
query("select_pipeline_max", "SELECT max(o_orderkey) AS val FROM orders WHERE o_custkey < 20 AND o_totalprice >= 30")(
    script("s1=select(db.orders.o_custkey,null,20)\nf1=fetch(db.orders.o_totalprice,s1)\ns2=select(s1,f1,30,null)\nf2=fetch(db.orders.o_orderkey,s2)\nr=max(f2)\ntuple(r)")
)
query("hash_join", "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 300")(
    lambda s, d: relational.hash_join(table(s, d, "lineitem"), table(s, d, "orders").filter("o_custkey < 300"), F.expr("l_orderkey = o_orderkey")).select("l_orderkey", "l_linenumber", "l_quantity", "o_custkey")
)
query("sorted_values", "SELECT o_custkey FROM orders ORDER BY o_custkey")(lambda s, d: relational.sort_values(table(s, d, "orders").select("o_custkey"), "o_custkey"))
query("sorted_layout", "SELECT o_custkey, o_totalprice FROM orders ORDER BY o_custkey")(lambda s, d: layout.sorted_layout(table(s, d, "orders").select("o_custkey", "o_totalprice"), "o_custkey"))
query("value_histogram", "SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 51 ELSE 1 + floor(o_totalprice / 10000.0) END AS BIGINT) AS bin, count(*) AS cnt FROM orders GROUP BY 1")(
    lambda s, d: relational.histogram(table(s, d, "orders"), "o_totalprice", 0, 500000, 50)
)

# -- catalog

_COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}
query("show_catalog", " UNION ALL ".join(f"SELECT 'db' AS db, '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS length, unnest({c}) AS \"column\"" for t, c in _COLUMNS.items()))(script("show_db"))


@query("create_and_insert", "SELECT CAST(pos AS BIGINT) AS pos, a, b, part_id, is_fence FROM (VALUES (0, 1, -11, 0, true)) t(pos, a, b, part_id, is_fence)")
def create_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = Session(spark)
    return fresh.run_script('create(db,"d")\ncreate(tbl,"t",d,2)\ncreate(col,"a",d.t,unsorted)\ncreate(col,"b",d.t,sorted)\nrelational_insert(d.t,1,-11)\nshow_tbl(d.t)')[-1]


# -- changes

_FIRST = f"(SELECT min(o_orderkey) FROM orders WHERE o_custkey = {POINT})"
_KEPT = "o_orderkey AS pos, o_custkey, o_totalprice"
kept = lambda s, d: orders(s, d).select(POS, "o_custkey", "o_totalprice")
query("insert_tuple", f"SELECT {_KEPT} FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1, 7, 12.5")(lambda s, d: dml.insert(kept(s, d), [(7, 12.5)]))
query("delete_first", f"SELECT {_KEPT} FROM orders WHERE o_orderkey <> {_FIRST}")(lambda s, d: dml.delete_first(kept(s, d), "o_custkey", POINT))
query("delete_missing", f"SELECT {_KEPT} FROM orders")(lambda s, d: dml.delete_first(kept(s, d), "o_custkey", -5))
query("delete_positions", f"SELECT {_KEPT} FROM orders WHERE NOT (o_custkey >= {LOW} AND o_custkey < {HIGH})")(lambda s, d: dml.delete_at(kept(s, d), chosen(s, d)))
query("update_first", f"SELECT o_orderkey AS pos, CASE WHEN o_orderkey = {_FIRST} THEN 77 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders")(lambda s, d: dml.update_first(kept(s, d), "o_custkey", POINT, 77))
_WRITES = "SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'insert' ELSE 'delete' END AS op, user_id * 7 % 1000 AS value FROM events WHERE event_type <> 'signup'"


@query(
    "replay_summary",
    f"""WITH w AS ({_WRITES}), old AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT value AS v, op, -sum(CASE WHEN op = 'insert' THEN 1 ELSE -1 END) OVER (PARTITION BY value ORDER BY seq) - coalesce(n, 0) AS excess
      FROM w LEFT JOIN old ON old.v = w.value),
gone AS (SELECT v, count(*) FILTER (WHERE op = 'delete') - greatest(max(excess), 0) AS gone FROM x GROUP BY v),
everything AS (SELECT o_custkey AS v, o_orderkey AS pos FROM orders UNION ALL SELECT value, (SELECT max(o_orderkey) FROM orders) + 1 + seq FROM w WHERE op = 'insert'),
ranked AS (SELECT e.v, pos, row_number() OVER (PARTITION BY e.v ORDER BY pos) AS r, coalesce(gone, 0) AS gone FROM everything e LEFT JOIN gone ON gone.v = e.v)
SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(pos % 1000003) AS BIGINT) AS checksum FROM ranked WHERE r > gone""",
)
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("view", "click"), "insert").otherwise("delete")
    writes = table(spark, sf_dir, "events").filter("event_type <> 'signup'").select(F.col("event_id").alias("seq"), op.alias("op"), F.expr("user_id * 7 % 1000").alias("value"))
    out = dml.replay(orders(spark, sf_dir).select(POS, "o_custkey"), "o_custkey", writes)
    return out.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"), F.sum(F.expr("pos % 1000003")).alias("checksum"))


# -- layouts

query("partition_assign", f"SELECT * FROM {PARTED}")(parted)
_INFO = f"""SELECT i AS part_id, CAST(p AS BIGINT) AS "pivot", count(pos) AS size FROM (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(PIVOTS.pivots))}) v(i, p) LEFT JOIN {PARTED} ON part_id = i GROUP BY i, p"""
query("partition_sizes", f"SELECT part_id, count(*) AS size FROM {PARTED} GROUP BY part_id")(lambda s, d: layout.sizes(parted(s, d)))
query("partition_offsets", f"SELECT part_id, CAST(sum(size) OVER (ORDER BY part_id) - 1 AS BIGINT) AS last FROM ({_INFO})")(lambda s, d: layout.info(parted(s, d), PIVOTS).select(PART, "last"))
query("partition_info", f'SELECT part_id, "pivot", size FROM ({_INFO})')(lambda s, d: layout.info(parted(s, d), PIVOTS).select(PART, "pivot", "size"))
query("partition_info_json", f"""SELECT '{{"sizes\":[' || string_agg(size, ',' ORDER BY part_id) || '],"pivots":[' || string_agg("pivot", ',' ORDER BY part_id) || ']}}' AS info FROM ({_INFO})""")(lambda s, d: layout.info_json(parted(s, d), PIVOTS))
query("partition_remap", f"SELECT pos, part_id, row_number() OVER (ORDER BY part_id, pos) - 1 AS new_pos FROM {PARTED}")(lambda s, d: layout.remap(parted(s, d), PIVOTS))
query("show_table", f"SELECT *, pos = max(pos) OVER (PARTITION BY part_id) AS is_fence FROM {PARTED}")(lambda s, d: layout.shown(parted(s, d)))
query("partition_scan", f"SELECT pos FROM {PARTED} WHERE part_id = 2")(lambda s, d: layout.scan_partition(parted(s, d), 2).select(POS))
for _name, _mask, _sign in (("gt", GREATER, ">"), ("lt", LESS, "<"), ("eq", EQUAL, "=")):
    query(f"partition_scan_{_name}", f"SELECT pos FROM {PARTED} WHERE part_id = 2 AND o_custkey {_sign} 300")(
        lambda s, d, m=_mask: layout.scan_partition(parted(s, d), 2, {GREATER: F.col("o_custkey") > 300, LESS: F.col("o_custkey") < 300, EQUAL: F.col("o_custkey") == 300}[m]).select(POS)
    )
query("pruned_point", f"SELECT o_orderkey AS pos, o_custkey FROM orders WHERE o_custkey = {POINT} ORDER BY o_orderkey LIMIT 1")(lambda s, d: layout.select_first(on_disk(s, d), PIVOTS, POINT).select(POS, "o_custkey"))
query("pruned_range", "SELECT o_orderkey AS pos, o_custkey FROM orders WHERE o_custkey >= 200 AND o_custkey < 800")(lambda s, d: layout.select_range(on_disk(s, d), PIVOTS, 200, 800).select(POS, "o_custkey"))
query("partition_json", f"SELECT pos, o_custkey, o_totalprice, part_id FROM {PARTED}")(lambda s, d: _as_json(s, d))
query("equal_depth_tiles", 'SELECT CAST(t AS INT) AS tile, max(o_custkey) AS "pivot", count(*) AS size FROM (SELECT o_custkey, ntile(16) OVER (ORDER BY o_custkey, o_orderkey) AS t FROM orders) GROUP BY t')(lambda s, d: layout.tiles(orders(s, d), "o_custkey", 16))


def _as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "json")
    parted(spark, sf_dir).write.partitionBy(PART).json(path)
    return spark.read.schema("pos long, o_custkey long, o_totalprice double, part_id int").json(path)


def _column_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of events on the values of o_custkey, with ranges and updates."""
    one = F.expr("(user_id * 131 + event_id) % 1000")
    two = F.when(F.col("op") == 1, one + 40).when(F.col("op") == 3, F.expr("user_id * 17 % 1000")).otherwise(0)
    events = table(spark, sf_dir, "events").withColumn("op", F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in OPS.items())).cast("int"))
    return events.select(F.col("event_id").alias("seq"), "op", one.alias("num1"), two.alias("num2"))


BINS = 48
#: The decision as a dynamic program over the bins: costs(j, c) has the cost of a partition from bin i + 1 to bin j at
#: place i + 1 of c, and step j finds the best end before it.
_DECIDED = f"""
WITH RECURSIVE ev AS (SELECT CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in OPS.items())} END AS INT) AS op,
    (user_id * 131 + event_id) % 1000 AS num1, CASE event_type WHEN 'click' THEN (user_id * 131 + event_id) % 1000 + 40 WHEN 'purchase' THEN user_id * 17 % 1000 ELSE 0 END AS num2 FROM events),
edges AS (SELECT DISTINCT max(o_custkey) AS p FROM (SELECT o_custkey, ntile({BINS}) OVER (ORDER BY o_custkey, o_orderkey) AS t FROM orders) GROUP BY t),
bins AS (SELECT p, CAST(row_number() OVER (ORDER BY p) AS INT) AS b FROM edges),
m AS (SELECT max(b) AS n, list(p ORDER BY b) AS ps FROM bins),
r AS (SELECT least(1 + len(list_filter(ps, lambda x: x < o_custkey)), n) AS b, count(*) AS cnt FROM orders, m GROUP BY 1),
w AS (SELECT op, least(1 + len(list_filter(ps, lambda x: x < num1)), n) AS a,
        least(1 + len(list_filter(ps, lambda x: x < CASE op WHEN 1 THEN num2 - 1 WHEN 3 THEN num2 ELSE num1 END)), n) AS b FROM ev, m),
o AS (SELECT op, a, b, count(*) AS c FROM w WHERE op = 3 OR a <= b GROUP BY ALL),
heads AS (SELECT bin, sum(c) AS c FROM (SELECT a AS bin, c FROM o WHERE op IN (0, 1, 3, 4) UNION ALL SELECT b, c FROM o WHERE op = 1) GROUP BY bin),
ij AS (SELECT i, j FROM range(0, 1000) x(i), range(1, 1000) y(j), m WHERE i < j AND j <= n),
cost AS (SELECT i, j, (SELECT coalesce(sum(cnt), 0) FROM r WHERE b > i AND b <= j)
    * ((SELECT coalesce(sum(c), 0) FROM heads WHERE bin > i AND bin <= j) - (SELECT coalesce(sum(c), 0) FROM o WHERE op = 1 AND a > i AND b > i AND a <= j AND b <= j))
    + CASE WHEN i > 0 THEN (SELECT coalesce(sum(c), 0) FROM o WHERE op IN (2, 4) AND a <= i)
        + (SELECT coalesce(sum(c), 0) FROM o WHERE op = 3 AND (a <= i AND b > i OR a > i AND b <= i)) ELSE 0 END AS c FROM ij),
costs AS (SELECT CAST(j AS INT) AS j, list(CAST(c AS DOUBLE) ORDER BY i) AS cs FROM cost GROUP BY j),
f AS (SELECT 0 AS j, [CAST(0 AS DOUBLE)] AS best, CAST([] AS BIGINT[]) AS origin UNION ALL
      SELECT j, list_append(best, list_min(v)), list_append(origin, list_position(v, list_min(v)) - 1)
      FROM (SELECT costs.j, best, origin, list_transform(cs, lambda x, k: x + best[k]) AS v FROM f JOIN costs ON costs.j = f.j + 1)),
back AS (SELECT origin, CAST(n AS BIGINT) AS e FROM f JOIN m ON f.j = n UNION ALL SELECT origin, origin[e] FROM back WHERE origin[e] > 0),
cuts AS (SELECT p AS pv, CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS part FROM back JOIN bins ON b = e),
sized AS (SELECT part, pv, count(o_custkey) AS size FROM cuts LEFT JOIN orders ON o_custkey <= pv AND o_custkey > coalesce((SELECT max(x.pv) FROM cuts x WHERE x.pv < cuts.pv), -1) GROUP BY part, pv)
SELECT part AS part_id, CAST(pv AS BIGINT) AS "pivot", size, CAST(sum(size) OVER (ORDER BY part) - 1 AS BIGINT) AS last FROM sized"""


@query("decided_layout", _DECIDED)
def decided_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, history = orders(spark, sf_dir).select(POS, "o_custkey"), _column_work(spark, sf_dir)
    chosen_layout = workload.decided(rows, "o_custkey", history, bins=BINS)
    return layout.info(layout.assign(rows, chosen_layout), chosen_layout)


@query("layout_by_commands", f"SELECT o_orderkey AS val {SELECTED}")
def layout_by_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decide, apply, and select with pruning, in one session."""
    own = session(spark, sf_dir)
    own.decide("db.orders.o_custkey", _column_work(spark, sf_dir), max_parts=32)
    own.apply("db.orders.o_custkey")
    return own.run_script(f"p=s(db.orders.o_custkey,{LOW},{HIGH})\ntuple(p)")[-1]


# -- layouts under change

PRICES = Layout("o_totalprice", (1000, 50_000, 90_000, 150_000, 300_000, 600_000))


@query("pruned_range_double", "SELECT o_orderkey AS pos, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 90000")
def pruned_range_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "prices")
    layout.write(orders(spark, sf_dir).select(POS, "o_totalprice"), PRICES, path)
    return layout.select_range(layout.read(spark, path), PRICES, 50_000, 90_000).select(POS, "o_totalprice")


def laid_out(spark: SparkSession, sf_dir: str) -> Session:
    """A session with orders partitioned by o_custkey."""
    catalog = Catalog(spark)
    catalog.register("db.o", kept(spark, sf_dir))
    out = Session(spark, sf_dir, catalog)
    out.decisions["db.o.o_custkey"] = PIVOTS
    out.apply("db.o.o_custkey")
    return out


def changed(text: str):
    """The table with its partitions after some commands."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = laid_out(spark, sf_dir)
        own.run_script(text)
        return own.catalog.table("db.o").frame(spark).select(POS, "o_custkey", "o_totalprice", PART)

    return run


_PART = f"CASE {CASE} ELSE {len(PIVOTS.pivots) - 1} END AS part_id"
_LAST = "(SELECT max(o_orderkey) FROM orders)"
query("insert_partitioned", f"SELECT *, {_PART} FROM (SELECT {_KEPT} FROM orders UNION ALL SELECT {_LAST} + v.i, v.c, v.p FROM (VALUES (1, 7, 12.0), (2, 9999, 3.0), (3, 250, 8.0)) v(i, c, p))")(changed("i(db.o,7,12)\ni(db.o,9999,3)\ni(db.o,250,8)"))
query("delete_partitioned", f"SELECT *, {_PART} FROM (SELECT {_KEPT} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = {POINT} ORDER BY o_orderkey LIMIT 2))")(changed(f"d(db.o.o_custkey,{POINT})\nd(db.o.o_custkey,{POINT})\nd(db.o.o_custkey,-5)"))
query("update_partitioned", f"SELECT *, {_PART} FROM (SELECT o_orderkey AS pos, CASE WHEN o_orderkey = {_FIRST} THEN 1400 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders)")(changed(f"u(db.o.o_custkey,{POINT},1400)"))
query("written_changes", f"SELECT *, {_PART} FROM (SELECT {_KEPT} FROM orders UNION ALL SELECT {_LAST} + i, i * 40, 1.0 FROM range(1, 141) t(i))")(changed("\n".join(f"i(db.o,{i * 40},1)" for i in range(1, 141))))


@query("reopened_layout", "SELECT o_orderkey AS pos, o_custkey FROM orders WHERE o_custkey >= 200 AND o_custkey < 800")
def reopened_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and opened again after a decision for another column; the range still prunes by the column of the layout."""
    own, folder = laid_out(spark, sf_dir), workspace(spark, "saved")
    own.decisions["db.o.o_totalprice"] = PRICES
    own.catalog.save(folder)
    other = Session(spark, sf_dir, Catalog.open(spark, folder))
    other.execute("p=s(db.o.o_custkey,200,800)")
    return other.variables["p"].rows.select(POS, "o_custkey")


@query("join_fetch", "SELECT o_totalprice AS val0, c_acctbal AS val1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey >= 100 AND o_custkey < 300 AND c_custkey >= 150")
def join_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = session(spark, sf_dir)
    own.catalog.register("db.customer", with_positions(table(spark, sf_dir, "customer"), "c_custkey"))
    return own.run_script(
        "p=s(db.orders.o_custkey,100,300)\nv=fetch(db.orders.o_custkey,p)\nq=s(db.customer.c_custkey,150,null)\nw=fetch(db.customer.c_custkey,q)\n"
        "x,y=join(v,p,w,q)\na=fetch(db.orders.o_totalprice,x)\nb=fetch(db.customer.c_acctbal,y)\ntuple(a,b)"
    )[-1]


# -- workloads

for _op, _name in ((0, "point"), (2, "insert"), (4, "delete")):
    query(f"workload_hist_{_name}", f"SELECT op, least(num1 // 10000, 99999) AS bucket, count(*) AS cnt FROM ({WORK_SQL}) WHERE op = {_op} GROUP BY 1, 2")(lambda s, d, o=_op: workload.histogram(work(s, d).filter(F.col("op") == o)))
for _op, _name in ((1, "range"), (3, "update")):
    query(f"workload_hist_{_name}", f"SELECT op, bucket, count(*) AS cnt FROM (SELECT op, unnest(range(least(num1 // 10000, 99999), least(num2 // 10000, 99999) + 1)) AS bucket FROM ({WORK_SQL}) WHERE op = {_op}) GROUP BY 1, 2")(
        lambda s, d, o=_op: workload.histogram(work(s, d).filter(F.col("op") == o))
    )
query("workload_op_mix", f"SELECT op, count(*) AS cnt FROM ({WORK_SQL}) GROUP BY op")(lambda s, d: workload.op_mix(work(s, d)))

# -- files and generators


def small_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two int columns of orders, in positions from 0: the ranks of their keys, counted in cells of keys."""
    rows = orders(spark, sf_dir).select(F.col(POS).alias("_key"), F.col("o_orderkey").cast("int").alias("a"), F.col("o_custkey").cast("int").alias("b"), F.lit(1).alias("_n"))
    return layout.running(rows, "_key", "_n").select((F.col("upto") - 1).alias(POS), "a", "b")


_INTS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey AS INT) AS a, CAST(o_custkey AS INT) AS b FROM orders"


@query("csv_load", _INTS)
def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = workspace(spark, "csv"), Session(spark)
    csvload.write(small_ints(spark, sf_dir), "foo.t", path)
    own.run_script(f'create(db,"foo")\ncreate(tbl,"t",foo,2)\ncreate(col,"a",foo.t,unsorted)\ncreate(col,"b",foo.t,unsorted)\nload("{path}")')
    return own.catalog.table("foo.t").frame(spark)


@query("csv_statistics", "SELECT count(*) + 2 AS lines, CAST(2 AS BIGINT) AS fields FROM orders")
def csv_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csv")
    csvload.write(small_ints(spark, sf_dir), "foo.t", path)
    return spark.createDataFrame([csvload.statistics(spark, path)], "lines long, fields long")


@query("csv_header", "SELECT unnest(['foo.t.a', 'foo.t.b']) AS name, CAST(2 AS BIGINT) AS header_lines")
def csv_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csv")
    csvload.write(small_ints(spark, sf_dir), "foo.t", path)
    names, skip = csvload.header(spark, path)
    return spark.createDataFrame([(n, skip) for n in names], "name string, header_lines long")


@query("binary_load", _INTS)
def binary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "binary")
    binary.write(spark, path, "foo", {"foo.t": small_ints(spark, sf_dir)})
    return Catalog.open_binary(spark, path).table("foo.t").frame(spark)


@query("reopened_catalog", f"SELECT 'foo' AS db, 't' AS \"table\", (SELECT count(*) FROM orders) AS length, unnest(['a', 'b']) AS \"column\"")
def reopened_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = workspace(spark, "saved"), Catalog(spark)
    own.register("foo.t", small_ints(spark, sf_dir))
    own.save(path)
    return Catalog.open(spark, path).show()


_OPERATIONS = f"SELECT op, CAST(num1 AS INT) AS num1, CAST(num2 AS INT) AS num2 FROM ({WORK_SQL})"


@query("parsed_workload", _OPERATIONS)
def parsed_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "parsed")
    workloads.write_parsed(work(spark, sf_dir), path)
    return workloads.parsed(spark, path).select("op", "num1", "num2")


@query("text_workload", _OPERATIONS)
def text_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "commands")
    workloads.commands(work(spark, sf_dir), "foo.t.a", 2).select("command").write.text(path)
    return workloads.text(spark, path).select("op", "num1", "num2")


@query("generated_data", "SELECT CAST(500 AS BIGINT) AS cnt, CAST(500 AS BIGINT) AS different, true AS inside, CAST(500 AS BIGINT) AS copies")
def generated_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.min("a") >= 0) & (F.max("a") < 10_000)
    return workloads.data(spark, 500, 2, domain=10_000).agg(F.count("*").alias("cnt"), F.count_distinct("a").alias("different"), inside.alias("inside"), F.count(F.when(F.expr("a = b"), 1)).alias("copies"))


@query("generated_workload", "SELECT CAST(4000 AS BIGINT) AS cnt, true AS near_mix, CAST(0 AS BIGINT) AS wrong")
def generated_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of operations are within 3 percent of those asked for, and values in the domain and of the asked width."""
    made = workloads.generate(spark, 4000, 10_000, seed=5)
    near = [F.abs(F.count(F.when(F.col("op") == op, 1)) / 4000 - share) < 0.03 for op, share in workloads.MIX.items()]
    wrong = F.count(F.when(F.expr("num1 < 0 OR num1 >= 10000 OR op = 1 AND num2 <> num1 + 100 OR op IN (0, 2, 4) AND num2 <> 0"), 1))
    return made.agg(F.count("*").alias("cnt"), reduce(and_, near).alias("near_mix"), wrong.alias("wrong"))


# -- runs of commands


def worked(spark: SparkSession, sf_dir: str, lines: list[str]) -> tuple[Session, DataFrame]:
    own, path = laid_out(spark, sf_dir), workspace(spark, "work")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return own, own.exec_work(path)


#: Inserts of new values, then updates of them, deletes of some, and updates and deletes of values that are there.
_LINES_OF_WORK = [
    *(f"i(db.o,{50_000 + i},1)" for i in range(90)),
    *(f"u(db.o.o_custkey,{50_000 + i},{60_000 + i})" for i in range(90)),
    *(f"d(db.o.o_custkey,{60_000 + i})" for i in range(0, 90, 3)),
    "p=s(db.o.o_custkey,100,300)",
    "p=s(db.o.o_custkey,60000,60090)",
    *(x for v in range(1, 41) for x in (f"u(db.o.o_custkey,{v},{v + 20_000})", f"u(db.o.o_custkey,{v},{v + 20_000})", f"d(db.o.o_custkey,{v})")),
]


@query(
    "exec_work_rows",
    f"""SELECT pos, o_custkey, o_totalprice, {_PART} FROM (
SELECT o_orderkey AS pos, CASE WHEN o_custkey BETWEEN 1 AND 40 AND r <= 2 THEN o_custkey + 20000 ELSE o_custkey END AS o_custkey, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE NOT (o_custkey BETWEEN 1 AND 40 AND r = 3)
UNION ALL SELECT {_LAST} + 1 + i, 60000 + i, 1.0 FROM range(0, 90) t(i) WHERE i % 3 <> 0)""",
)
def exec_work_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = worked(spark, sf_dir, _LINES_OF_WORK)
    return own.catalog.table("db.o").frame(spark).select(POS, "o_custkey", "o_totalprice", PART)


@query("exec_work_log", "SELECT * FROM (VALUES ('delete', CAST(70 AS BIGINT)), ('insert', 90), ('select', 2), ('update', 170)) v(op, cnt)")
def exec_work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = worked(spark, sf_dir, _LINES_OF_WORK)
    return log.select("op", "cnt")


@query("exec_work_selection", "SELECT 60000 + i AS val FROM range(0, 90) t(i) WHERE i % 3 <> 0")
def exec_work_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = worked(spark, sf_dir, _LINES_OF_WORK[:272])
    return own.run_script("f=fetch(db.o.o_custkey,p)\ntuple(f)")[-1]


query("drop_table", " UNION ALL ".join(f"SELECT 'db' AS db, '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS length, unnest({c}) AS \"column\"" for t, c in _COLUMNS.items() if t == "orders"))(script("drop(tbl,db.lineitem)\nshow_db"))


@query("satisfied_layout", "SELECT true AS within, true AS reads_less, true AS has_slots")
def satisfied_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout chosen under bounds keeps them; with looser bounds it reads no more."""
    own, history = laid_out(spark, sf_dir), _column_work(spark, sf_dir)
    tight = own.satisfy("db.o.o_custkey", history, update=4.0, memory=0.05, bins=BINS)
    loose = own.satisfy("db.o.o_custkey", history, update=40.0, memory=0.2, bins=BINS)
    slots = sum(own.decisions["db.o.o_custkey"].ghosts) >= 0 and len(own.decisions["db.o.o_custkey"].ghosts) == len(own.decisions["db.o.o_custkey"].pivots)
    within = tight["update"] <= 4.0 and tight["memory"] <= 0.05 and loose["update"] <= 40.0
    return spark.createDataFrame([(within, loose["read"] <= tight["read"], slots)], "within boolean, reads_less boolean, has_slots boolean")
