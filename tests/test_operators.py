import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.functions.comparators import EQUAL, GREATER, LESS, chain
from palisade.functions.lookup import partition_of, place
from palisade.operators import dml, layout, workload
from palisade.operators.layout import Layout
from palisade.plans.catalog import Catalog
from palisade.session import Session
from palisade.sources import binary, csvload, workloads
from palisade.streaming import histograms


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, a int")


@pytest.mark.parametrize("pivots", [[5], [1, 5, 9], list(range(0, 1000, 3))])
def test_lookup(spark, pivots):
    values = [-5, 0, 1, 2, 5, 6, 9, 10, 500, 999, 1000, 2147483647, -2147483648]
    got = frame(spark, values).select("a", partition_of(F.col("a"), pivots).alias("p")).collect()
    assert all(r["p"] == place(pivots, r["a"]) for r in got)


def test_chain_folds_from_the_left(spark):
    tests = [(None, LESS, 3), ("or", GREATER, 7), ("and", EQUAL | LESS, 8), ("or", EQUAL, 100)]
    got = [r["a"] for r in frame(spark, range(12)).filter(chain(F.col("a"), tests)).collect()]
    assert got == [v for v in range(12) if ((v < 3 or v > 7) and v <= 8) or v == 100]


@pytest.mark.parametrize("seed", range(3))
def test_partitioned_equals_plain(spark, tmp_path, seed):
    rng = random.Random(seed)
    values = [rng.randrange(-40, 40) for _ in range(120)]
    chosen = Layout("a", tuple(sorted(rng.sample(range(-45, 45), 5))))
    path = str(tmp_path / "t")
    layout.write(frame(spark, values), chosen, path)
    disk = layout.read(spark, path)
    for low, high in [(-10, 10), (None, 0), (5, None), (20, 20), (30, -30), (chosen.pivots[1], chosen.pivots[2] + 1)]:
        got = sorted(r["pos"] for r in layout.select_range(disk, chosen, low, high).collect())
        assert got == [i for i, v in enumerate(values) if (low is None or v >= low) and (high is None or v < high)]
    for v in (values[0], 99):
        assert [r["pos"] for r in layout.select_first(disk, chosen, v).collect()] == [i for i, x in enumerate(values) if x == v][:1]
    mapped = {r["pos"]: r["new_pos"] for r in layout.remap(layout.assign(frame(spark, values), chosen), chosen).collect()}
    order = sorted(range(len(values)), key=lambda i: (chosen.part(values[i]), i))
    assert mapped == {p: i for i, p in enumerate(order)}
    assert sum(r["size"] for r in layout.info(disk, chosen).collect()) == len(values)


def test_pruning_reaches_the_scan(spark, tmp_path):
    chosen = Layout("a", (10, 20, 30))
    layout.write(frame(spark, range(40)), chosen, str(tmp_path / "t"))
    found = layout.select_range(layout.read(spark, str(tmp_path / "t")), chosen, 12, 18)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_id" in plan
    assert "PushedFilters: [IsNotNull(a), GreaterThanOrEqual(a,12), LessThan(a,18)]" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    layout.replace(frame(spark, [15, 16]), chosen, str(tmp_path / "t"), [1])
    assert sorted(r["a"] for r in layout.read(spark, str(tmp_path / "t")).filter("part_id = 1").collect()) == [15, 16]


@pytest.mark.parametrize("seed", range(4))
def test_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4)) for i in range(8)]
    writes = [(i, rng.choice(["insert", "delete", "delete"]), rng.randrange(5)) for i in range(30)]
    alive, last = dict(rows), rows[-1][0]
    for seq, op, v in writes:
        if op == "insert":
            alive[last + 1 + seq] = v
        elif hits := [p for p, x in alive.items() if x == v]:
            del alive[min(hits)]
    out = dml.replay(spark.createDataFrame(rows, "pos long, a int"), "a", spark.createDataFrame(writes, "seq long, op string, value int"))
    assert {r["pos"]: r["a"] for r in out.collect()} == alive


def test_insert_needs_all_values(spark):
    with pytest.raises(ValueError):
        dml.insert(frame(spark, [1]), [()])


def test_histograms(spark):
    ops = [(0, 5, 0), (0, 10_000, 0), (1, 5, 30_000), (1, 30_000, 5), (3, 25_000, 25_000), (4, 2_000_000_000, 0), (2, -7, 0)]
    work = spark.createDataFrame([(i, *x) for i, x in enumerate(ops)], workloads.SCHEMA)
    got = {(r["op"], r["bucket"]): r["cnt"] for r in workload.histogram(work).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (3, 2): 1, (4, 99_999): 1, (2, 0): 1}


def cost(b, ends):
    """The model, operation by operation."""
    n = len(b["edges"])
    part = np.searchsorted(np.array(ends), np.arange(n))
    size = np.bincount(part, b["rows"])
    total = 0.0
    for i in range(n):
        for j in range(n):
            p, q = part[i], part[j]
            total += b[0][i, j] * size[p] + b[1][i, j] * (size[p] + (size[q] if p != q else 0)) + b[2][i, j] * (len(ends) - 1 - p)
            total += b[4][i, j] * (size[p] + len(ends) - 1 - p) + b[3][i, j] * (size[p] + abs(p - q))
    return total


@pytest.mark.parametrize("seed", range(5))
def test_decision_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n = 7
    b = {"edges": list(range(n)), "rows": rng.integers(1, 20, n).astype(float)}
    for op in range(5):
        m = rng.integers(0, 6, (n, n)).astype(float) * (rng.random((n, n)) < 0.5)
        b[op] = m if op == 3 else np.triu(m) if op == 1 else np.diag(np.diag(m))
    every = [[i for i in range(n - 1) if k >> i & 1] + [n - 1] for k in range(1 << n - 1)]
    for limit in (None, 3):
        ends, least = workload.decide(b, limit)
        best = min(cost(b, e) for e in every if limit is None or len(e) <= limit)
        assert least == pytest.approx(best) and cost(b, ends) == pytest.approx(best)
    assert set(workload.expected(b, [2, n - 1])) == {"read", "update", "memory"}


def test_free_slots_and_bounds():
    """Slots follow the expected arrivals and spare moves; a layout under bounds keeps them, and one partition moves nothing."""
    rng = np.random.default_rng(4)
    n = 12
    b = {"edges": list(range(n)), "rows": rng.integers(50, 90, n).astype(float)}
    for op in range(5):
        m = rng.integers(0, 6, (n, n)).astype(float)
        b[op] = m if op == 3 else np.triu(m) if op == 1 else np.diag(np.diag(m))
    ends = [3, 7, n - 1]
    free = workload.ghosts(b, ends, 40)
    assert sum(free) == 40 and free != (14, 13, 13)
    bare, eased = workload.expected(b, ends), workload.expected(b, ends, free)
    assert eased["update"] < bare["update"] and eased["read"] == bare["read"] and eased["memory"] == pytest.approx(40 / b["rows"].sum()) and bare["memory"] == 0
    every = workload.trade_offs(b)
    assert min(x["update"] for x in every) == 0.0
    for limit in (0.0, 0.5, 1.0, 5.0):
        found = workload.satisfying(b, update=limit, memory=0.0)
        assert found["update"] <= limit and found["memory"] == 0 and found["read"] == min(x["read"] for x in every if x["update"] <= limit and x["memory"] == 0)
    assert workload.satisfying(b, read=0.0) is None


@pytest.mark.parametrize("algo", [0, 1, 2, 4, 5])
def test_algorithms(spark, algo):
    rows = frame(spark, [i * i % 97 for i in range(200)])
    work = spark.createDataFrame([(i, i % 5, i, i + 9) for i in range(90)], workloads.SCHEMA)
    chosen = workload.decided(rows, "a", work, algo, parts=4, bins=16)
    assert chosen.pivots[-1] >= 96 and (algo != 4 or len(chosen.pivots) == 1)
    assert sum(r["size"] for r in layout.info(layout.assign(rows, chosen), chosen).collect()) == 200


def test_edge_tables(spark):
    for values in ([], [3, 3, 3]):
        rows = frame(spark, values)
        for chosen in (layout.equal_depth(rows, "a", 4), layout.equal_width(rows, "a", 4), Layout("a", (0, 1))):
            assert sum(r["size"] for r in layout.info(layout.assign(rows, chosen), chosen).collect()) == len(values)
    assert layout.tiles(frame(spark, []), "a", 4).count() == 0


def test_binary_folder_from_spark(spark, tmp_path):
    rows = [(i, x, -x) for i, x in enumerate([5, -1, 2147483647, -2147483647, 0, 255, 256, -256, 65536])]
    given = spark.createDataFrame(rows, "pos long, a int, b int").repartition(3)
    binary.write(spark, str(tmp_path), "foo", {"foo.t": given})
    db, tables = binary.load(spark, str(tmp_path))
    assert db == "foo" and sorted(map(tuple, tables["foo.t"].select("pos", "a", "b").collect())) == rows


def test_tiles_where_values_repeat(spark):
    for values, parts in (([5] * 10 + [7], 4), (list(range(7)), 10), ([1, 2, 2, 2, 3, 9, 9], 3), ([4], 1)):
        got = [tuple(r) for r in layout.tiles(frame(spark, values), "a", parts).orderBy("tile").collect()]
        rest, want = sorted(values), []
        for t in range(min(parts, len(values))):
            n = len(values) // parts + (t < len(values) % parts)
            want.append((t + 1, rest[n - 1], n))
            rest = rest[n:]
        assert got == want


def test_binary_folder(spark, tmp_path):
    a = pd.DataFrame({"x": [5, -1, 2147483647, -2147483648, 7], "y": [1, 2, 3, 4, 5]})
    binary.save(str(tmp_path), "foo", {"foo.tb1": a})
    db, tables = binary.load(spark, str(tmp_path))
    got = tables["foo.tb1"].orderBy("pos").toPandas()
    opened = Session(spark, catalog=Catalog.open_binary(spark, str(tmp_path)))
    assert [r[0] for r in opened.run_script("p=s(foo.tb1.x,0,10)\nf=fetch(foo.tb1.y,p)\ntuple(f)")[0].collect()] == [1, 5]
    assert db == "foo" and got["pos"].tolist() == [0, 1, 2, 3, 4] and got["x"].tolist() == a["x"].tolist() and got["y"].tolist() == a["y"].tolist()


def test_parsed_workload(spark, tmp_path):
    given = {"pq_cost": [4, 5], "rq_cost_beg": [1], "rq_cost_end": [9], "in_cost": [], "up_cost_beg": [7], "up_cost_end": [3], "de_cost": [8]}
    for name, xs in given.items():
        np.array([len(xs), *xs], "<i4").tofile(tmp_path / name)
    got = sorted((r["op"], r["num1"], r["num2"]) for r in workloads.parsed(spark, str(tmp_path)).collect())
    assert got == [(0, 4, 0), (0, 5, 0), (1, 1, 9), (3, 7, 3), (4, 8, 0)]
    assert [r["cnt"] for r in workload.op_mix(workloads.parsed(spark, str(tmp_path))).orderBy("op").collect()] == [2, 1, 1, 1]


def test_csv_without_counts(spark, tmp_path):
    (tmp_path / "f").write_text("foo.t.a,foo.t.b\n5, 6\n\n-7,8\n")
    names, rows = csvload.load(spark, str(tmp_path / "f"))
    assert names == ["foo.t.a", "foo.t.b"] and [tuple(r) for r in rows.orderBy("pos").collect()] == [(0, 5, 6), (1, -7, 8)]
    assert csvload.statistics(spark, str(tmp_path / "f")) == (4, 2)


def test_several_load_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_text("2,2\nfoo.t.a,foo.t.b\n" + "".join(f"{10 * i + j},{j}\n" for j in range(2)))
    names, rows = csvload.load(spark, str(tmp_path))
    got = [tuple(r) for r in rows.orderBy("pos").collect()]
    assert names == ["foo.t.a", "foo.t.b"] and [p for p, _, _ in got] == list(range(6))
    assert sorted((a, b) for _, a, b in got) == [(10 * i + j, j) for i in range(3) for j in range(2)]


def test_load_while_splits_change(spark, tmp_path):
    """Splits of files depend on settings and on the cluster's cores, which can change before all uses of a scan began."""
    n, key, done = 5000, "spark.sql.files.maxPartitionBytes", threading.Event()
    for i in range(2):
        (tmp_path / f"f{i}").write_text(f"{n},2\nfoo.t.a,foo.t.b\n" + "".join(f"{i * n + j},{j}\n" for j in range(n)))
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")

    def change():
        while not done.wait(0.001):
            if spark.sparkContext.statusTracker().getActiveJobsIds():
                spark.conf.set(key, "32k")

    changes = threading.Thread(target=change)
    try:
        _, rows = csvload.load(spark, str(tmp_path))
        changes.start()
        got = sorted(map(tuple, rows.collect()))
        done.set()
        changes.join()
    finally:
        done.set()
        spark.conf.set(key, before)
    assert [p for p, _, _ in got] == list(range(2 * n)) and sorted(a for _, a, _ in got) == list(range(2 * n))
    assert all(b == p % n for p, _, b in got)


def test_nulls_in_load_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, None), (1, None, 2), (2, None, None), (3, 4, 5)], "pos long, a int, b int")
    csvload.write(rows, "foo.t", f"{tmp_path}/csv")
    assert sorted(map(tuple, csvload.load(spark, f"{tmp_path}/csv")[1].collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(Exception, match="blank line"):
        csvload.write(rows.select("pos", "a"), "foo.t", f"{tmp_path}/one")


def test_generators(spark):
    rows = workloads.data(spark, 500, 3, domain=10_000)
    assert rows.columns == ["pos", "a", "b", "c"] and rows.select("a").distinct().count() == 500
    for kind in ("zipf", "gauss", "beta", "uniform"):
        low, high = spark.range(300).select(workloads.values(kind, 1000, 5).alias("v")).agg(F.min("v"), F.max("v")).first()
        assert 0 <= low <= high < 1000


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", 0, 5), ("2024-01-01 00:00:02", 0, 15_000), ("2024-01-01 00:25:00", 2, 5), ("2024-01-01 01:00:00", 2, 5)]
    spark.createDataFrame(rows, "ts string, op int, num1 int").selectExpr("CAST(ts AS timestamp) AS ts", "op", "num1").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, op int, num1 int").parquet(str(tmp_path / "in"))
    q = histograms.windowed(stream).writeStream.outputMode("append").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["op"], r["bucket"], r["cnt"]) for r in spark.table("hist").collect()) == [(0, 0, 1), (0, 1, 1), (2, 0, 1)]
