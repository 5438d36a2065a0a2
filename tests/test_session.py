import random

import pytest
from pyspark.sql import functions as F

from palisade.operators.layout import Layout
from palisade.plans.catalog import Catalog, CommandError
from palisade.session import Session

# Ten rows of the shared golden table.
TEN = [
    (-1, -11, -111, -1111, -11111, 1, 11, 111, 1111, 11111),
    (-2, -22, -222, -2222, -11111, 1, 11, 111, 1111, 11511),
    (-3, -33, -333, -2222, -11111, 1, 11, 111, 1911, 11111),
    (-4, -44, -444, -2222, -11111, 1, 11, 111, 1111, 11511),
    (-5, -55, -555, -2222, -15111, 1, 11, 111, 1811, 11111),
    (-6, -66, -666, -2222, -11111, 1, 16, 111, 1111, 13411),
    (-7, -77, -777, -2222, -11111, 1, 11, 711, 1111, 11111),
    (-8, -88, -888, -2222, -18101, 1, 11, 111, 8111, 11211),
    (-9, -99, -999, -2222, -91141, 1, 11, 111, 1111, 16711),
    (-10, -11, 0, -34, -11111, 1, 11, 111, 1111, 11111),
]


def values(df):
    return [r[0] for r in df.collect()]


@pytest.fixture
def ten(spark):
    s = Session(spark)
    s.run_script('create(db,"db1")\ncreate(tbl,"tbl1",db1,10)\n' + "\n".join(f'create(col,"col{i}",db1.tbl1,unsorted)' for i in range(1, 11)))
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(TEN)], "pos long, " + ", ".join(f"col{i} int" for i in range(1, 11)))
    s.catalog.table("db1.tbl1").replace(rows)
    return s


def small(spark, rows, columns="a int, b int"):
    s = Session(spark)
    s.catalog.register("d.t", spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos long, {columns}"))
    return s


def test_selection_in_insertion_order(ten):
    """A range without matches, and one that holds the ten rows' smaller values, in the order of the rows."""
    none = ten.run_script("low=s(db1.tbl1.col10,-999,999)\nnine=fetch(db1.tbl1.col9,low)\ntuple(nine)")[0]
    some = ten.run_script("most=s(db1.tbl1.col10,null,12000)\nnine=fetch(db1.tbl1.col9,most)\ntuple(nine)")[0]
    assert values(none) == [] and values(some) == [r[8] for r in TEN if r[9] < 12000]


def test_aggregates_and_arithmetic(ten):
    got = ten.run_script("""
s1=select(db1.tbl1.col2,null,-20)
f1=fetch(db1.tbl1.col3,s1)
s2=select(s1,f1,-700,null)
f2=fetch(db1.tbl1.col1,s2)
r=max(f2)
tuple(r)
a=avg(db1.tbl1.col7)
tuple(a)
x=add(f1,f1)
m=min(x)
tuple(m)
y=sub(f1,f2)
c=count(y)
tuple(c)""")
    assert [values(g)[0] for g in got] == [-2, 11.5, -1998, 5]


def test_sums_exceed_32_bits(spark):
    s = small(spark, [(2147483647, 2147483647), (-2147483648, 2147483647)])
    got = s.run_script("p=s(d.t.a,null,null)\nx=fetch(d.t.a,p)\ny=fetch(d.t.b,p)\nz=add(x,y)\ntuple(z)\nw=sub(x,y)\ntuple(w)\nt=sum(d.t.b)\ntuple(t)")
    assert [values(g) for g in got] == [[4294967294, -1], [0, -4294967295], [4294967294]]


def test_point_selection_takes_the_first(spark):
    s = small(spark, [(5, 1), (7, 2), (5, 3)])
    assert values(s.run_script("p=s(d.t.a,5,6)\nf=fetch(d.t.b,p)\ntuple(f)")[0]) == [1]
    assert values(s.run_script("p=s(d.t.a,5,7)\nf=fetch(d.t.b,p)\ntuple(f)")[0]) == [1, 3]
    assert values(s.run_script("p=s(d.t.a,9,3)\ntuple(p)")[0]) == []


def test_changes_make_versions(spark):
    s = small(spark, [(5, 1), (7, 2), (5, 3)])
    s.execute("p=s(d.t.a,0,10)")
    s.run_script("d(d.t.a,5)\nu(d.t.a,5,6)\ni(d.t,9,4,99)\nd(d.t.a,1000)")
    assert values(s.execute("tuple(p)")) == [0, 1, 2]
    s.run_script("q=s(d.t.a,null,null)\na=fetch(d.t.a,q)\nb=fetch(d.t.b,q)")
    assert [tuple(r) for r in s.execute("tuple(a,b)").collect()] == [(7, 2), (6, 3), (9, 4)]
    s.execute("f=fetch(d.t.b,p)")  # positions of the old version, values of the new one
    assert values(s.execute("tuple(f)")) == [2, 3]
    s.run_script('q=s(d.t.a,6,8)\nd(d.t.a,"q")\np=s(d.t.a,null,null)')
    assert values(s.execute("tuple(p)")) == [3]


def test_insert_into_empty_table(spark):
    s = Session(spark)
    s.run_script('create(db,"d")\ncreate(tbl,"t",d,1)\ncreate(col,"a",d.t)\ni(d.t,5)\ni(d.t,-5)\np=s(d.t.a,null,null)\nf=fetch(d.t.a,p)')
    assert values(s.execute("tuple(f)")) == [5, -5]
    assert [tuple(r) for r in s.execute("show_db").collect()] == [("d", "t", 2, "a")]


def test_many_changes(spark):
    s = small(spark, [(i, i) for i in range(30)])
    for i in range(20):
        s.execute(f"d(d.t.a,{i})")
    s.execute("p=s(d.t.a,null,null)")
    assert values(s.execute("tuple(p)")) == list(range(20, 30))


def test_layout(spark):
    s = small(spark, [(i * 7 % 50, i) for i in range(50)])
    before = {k: values(s.run_script(f"p=s(d.t.a,{k})\nf=fetch(d.t.b,p)\ntuple(f)")[0]) for k in ("3,30", "10,11", "null,9", "40,null")}
    s.decisions["d.t.a"] = Layout("a", (10, 20, 35, 60))
    s.apply("d.t.a")
    assert {k: values(s.run_script(f"p=s(d.t.a,{k})\nf=fetch(d.t.b,p)\ntuple(f)")[0]) for k in before} == before
    assert s.part_info("d.t.a").first()[0] == '{"sizes":[11,10,15,14],"pivots":[10,20,35,60]}'
    s.run_script("u(d.t.a,10,55)\ni(d.t,15,100)\nd(d.t.a,49)")
    assert s.part_info("d.t.a").first()[0] == '{"sizes":[10,11,15,14],"pivots":[10,20,35,60]}'
    plan = s.run_script("p=s(d.t.a,3,30)\ntuple(p)")[0]
    assert plan.count() == 27
    fences = [r["pos"] for r in s.execute("show_tbl(d.t.a)").collect() if r["is_fence"]]
    assert len(fences) == 4


def test_join(spark):
    s = small(spark, [(1, 10), (2, 20), (3, 20)])
    got = s.run_script("p=s(d.t.a,null,null)\nv=fetch(d.t.b,p)\nx,y=join(v,p,v,p)\ntuple(x)")[0]
    assert values(got) == [0, 1, 1, 2, 2]


def test_fetch_of_a_join(spark):
    """Both sides of the pairs, with their repeats, stay aligned; values of a join can be added and refined."""
    s = small(spark, [(1, 10), (2, 20), (3, 20), (4, 30)])
    got = s.run_script("""
p=s(d.t.a,null,4)
q=s(d.t.a,2,null)
v=fetch(d.t.b,p)
w=fetch(d.t.b,q)
x,y=join(v,p,w,q)
left=fetch(d.t.a,x)
right=fetch(d.t.a,y)
tuple(left,right)
sum_=add(left,right)
tuple(sum_)
some=select(x,left,3,null)
rest=fetch(d.t.b,some)
tuple(rest)
m=max(right)
tuple(m)""")
    assert [tuple(r) for r in got[0].collect()] == [(2, 2), (2, 3), (3, 2), (3, 3)]
    assert [values(g) for g in got[1:]] == [[4, 5, 5, 6], [20, 20], [3]]


def laid_out(spark, n=60):
    s = small(spark, [(i * 7 % 50, i) for i in range(n)])
    s.decisions["d.t.a"] = Layout("a", (10, 20, 35, 60))
    s.apply("d.t.a")
    return s


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("changes", [1, 16, 40])
def test_changes_keep_partitions(spark, changes, monkeypatch):
    """After any number of changes selections still prune directories, and the rows are those of a plain table."""
    rng = random.Random(changes)
    monkeypatch.setattr("palisade.session.CHANGES", 16)  # so that some are written and others held
    s, plain = laid_out(spark), small(spark, [(i * 7 % 50, i) for i in range(60)])
    for i in range(changes):
        line = rng.choice([f"i(d.t,{rng.randrange(70)},{100 + i})", f"d(d.t.a,{rng.randrange(50)})", f"u(d.t.a,{rng.randrange(50)},{rng.randrange(70)})", f"u(d.t.b,{rng.randrange(60)},{200 + i})", f"d(d.t.b,{rng.randrange(60)})"])
        for x in (s, plain):
            x.execute(line)
    for script in ("p=s(d.t.a,12,30)", "p=s(d.t.a,null,null)", "p=s(d.t.a,21,22)"):
        shown = [x.run_script(f"{script}\na=fetch(d.t.a,p)\nb=fetch(d.t.b,p)\ntuple(p,a,b)")[0].collect() for x in (s, plain)]
        assert shown[0] == shown[1]
    plan = explained(s.run_script("p=s(d.t.a,12,18)\ntuple(p)")[0])
    assert "PartitionFilters: [isnotnull(part_id" in plan and "(part_id" in plan and "CASE" not in plan
    at = s.run_script('p=s(d.t.a,0,25)\nd(d.t.a,"p")\nq=s(d.t.a,null,null)\na=fetch(d.t.a,q)\ntuple(a)')[0]
    assert min(values(at), default=25) >= 25 and not {0, 1} & set(s.catalog.table("d.t").store.held)
    left = s.run_script("show_tbl(d.t)")[0]
    assert all(r["part_id"] == s.catalog.table("d.t").layout.part(r["a"]) for r in left.collect())


def test_old_versions_stay(spark):
    s = laid_out(spark)
    s.run_script("p=s(d.t.a,0,11)\nf=fetch(d.t.b,p)")
    before = values(s.execute("tuple(f)"))
    for i in range(20):
        s.run_script(f"d(d.t.a,{i})\ni(d.t,{i},{i})")
    assert values(s.execute("tuple(f)")) == before


def test_doubles_are_pruned_rightly(spark):
    """Values between whole numbers, at, below and above pivots, and many pivots."""
    given = [100.0, 299.5, 299.0, 300.0, 500.25, 149.9, 150.0, 150.1, -3.5, 1000.0, 2000.5, None]
    for pivots in ((150, 299, 1000), tuple(range(0, 400, 2)), tuple(range(300)), tuple(range(0, 3000, 3))):
        s = small(spark, [(v, i) for i, v in enumerate(given)], "a double, b int")
        plain = small(spark, [(v, i) for i, v in enumerate(given)], "a double, b int")
        s.decisions["d.t.a"] = Layout("a", pivots)
        s.apply("d.t.a")
        for bounds in ("100,300", "299,300", "150,null", "null,150", "0,3000", "1000,1001"):
            got = [values(x.run_script(f"p=s(d.t.a,{bounds})\nf=fetch(d.t.b,p)\ntuple(f)")[0]) for x in (s, plain)]
            assert got[0] == got[1], (pivots[:3], bounds)
        placed = {r["b"]: r["part_id"] for r in s.execute("show_tbl(d.t)").collect()}
        assert placed == {i: s.catalog.table("d.t").layout.part(v) for i, v in enumerate(given)}


def test_sorted_columns(spark, tmp_path):
    """A column declared sorted clusters the files, so a range reads few row groups; results don't change."""
    (tmp_path / "f").write_text("d.t.a,d.t.b\n" + "\n".join(f"{i * 37 % 100},{i}" for i in range(100)))
    s = Session(spark)
    s.run_script(f'create(db,"d")\ncreate(tbl,"t",d,2)\ncreate(col,"a",d.t,sorted)\ncreate(col,"b",d.t,unsorted)\nload("{tmp_path}/f")')
    parts = s.catalog.table("d.t").rows.select("a", F.input_file_name().alias("f")).groupBy("f").agg(F.min("a").alias("x"), F.max("a").alias("y")).orderBy("x").collect()
    assert all(p["y"] < q["x"] for p, q in zip(parts, parts[1:], strict=False))
    assert values(s.run_script("p=s(d.t.a,10,12)\nf=fetch(d.t.b,p)\ntuple(f)")[0]) == sorted(i for i in range(100) if 10 <= i * 37 % 100 < 12)


@pytest.mark.parametrize(("seed", "partitioned"), [(0, False), (1, True)])
def test_exec_work_is_one_by_one(spark, tmp_path, seed, partitioned):
    """A file of commands has the results that its commands have one after the other."""
    rng = random.Random(seed)
    lines = ["i(d.t,1,1)"]
    for i in range(36):
        a, b = rng.randrange(12), rng.randrange(12)
        lines.append(rng.choice([f"i(d.t,{a},{i})", f"d(d.t.a,{a})", f"u(d.t.a,{a},{b})", f"u(d.t.a,{a},{b})", f"p=s(d.t.a,{a},{a + 4})", f"d(d.t.b,{a})", "-- nothing"]))
    (tmp_path / "work").write_text("\n".join(lines))
    sessions = [laid_out(spark, 30) if partitioned else small(spark, [(i * 7 % 50, i) for i in range(30)]) for _ in range(2)]
    log = sessions[0].exec_work(str(tmp_path / "work")).collect()
    for line in lines:
        sessions[1].execute(line)
    assert sum(r["cnt"] for r in log) == sum(not x.startswith("--") for x in lines) and all(r["seconds"] >= 0 for r in log)
    rows = [sorted(map(tuple, x.catalog.table("d.t").frame(spark).select("pos", "a", "b").collect())) for x in sessions]
    assert rows[0] == rows[1] and len(rows[0]) > 10
    assert values(sessions[0].execute("tuple(p)")) == values(sessions[1].execute("tuple(p)"))


def test_errors(spark, tmp_path):
    s = small(spark, [(1, 2)])
    for line in ['create(db,"e")', "p=s(d.t.z,1,2)", "tuple(nothing)", "i(d.t,1)", "f=fetch(d.t.a,nope)", "partition(d.t.a)", 'create(col,"c",d.t)', "p=s(d.u.a,1,2)", "x=max(nope)"]:
        with pytest.raises(CommandError):
            s.execute(line)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        s.execute(f'load("{tmp_path}/none")')
    s.execute("quit")
    with pytest.raises(CommandError):
        s.execute("show_db")


def test_load_and_workloads(spark, tmp_path):
    from palisade.sources import csvload, workloads

    rows = workloads.data(spark, 200, 2, domain=1000)
    csvload.write(rows, "foo.tb1", f"{tmp_path}/csv")
    s = Session(spark, str(tmp_path))
    s.run_script('create(db,"foo")\ncreate(tbl,"tb1",foo,2)\ncreate(col,"a",foo.tb1,unsorted)\ncreate(col,"b",foo.tb1,unsorted)')
    s.execute(f'load("{tmp_path}/csv")')
    assert s.catalog.table("foo.tb1").rows.orderBy("pos").collect() == rows.orderBy("pos").collect()
    with pytest.raises(CommandError):
        s.execute(f'load("{tmp_path}/csv")')
    work = workloads.generate(spark, 12, 1000, seed=3)
    lines = workloads.commands(work, "foo.tb1.a", 2)
    lines.coalesce(1).sortWithinPartitions("seq").select("command").write.text(f"{tmp_path}/work")
    back = workloads.text(spark, f"{tmp_path}/work").select("op", "num1", "num2")
    assert sorted(map(tuple, back.collect())) == sorted((r["op"], r["num1"], r["num2"]) for r in work.collect())
    log = s.execute(f'exec_work("{tmp_path}/work")')
    assert sum(r["cnt"] for r in log.collect()) == 12


def test_catalog_on_disk(spark, tmp_path):
    """A reopened layout prunes by its own column, whatever else was decided; a catalog can be saved where it was opened."""
    s, folder = small(spark, [(i % 9, i) for i in range(40)]), str(tmp_path / "saved")
    s.decisions["d.t.a"] = Layout("a", (3, 6, 8))
    s.apply("d.t.a")
    s.decisions["d.t.b"] = Layout("b", (10, 20, 40))
    s.execute("i(d.t,4,77)")
    s.catalog.save(folder)
    for _ in range(3):
        other = Session(spark, catalog=Catalog.open(spark, folder))
        for bounds in ("d.t.a,2,5", "d.t.b,5,15", "d.t.b,3,100"):
            assert values(other.run_script(f"p=s({bounds})\ntuple(p)")[0]) == values(s.run_script(f"p=s({bounds})\ntuple(p)")[0])
        assert "PartitionFilters: [isnotnull(part_id" in explained(other.run_script("p=s(d.t.a,2,3)\ntuple(p)")[0])
        for x in (s, other):
            x.run_script("d(d.t.a,4)\nu(d.t.b,12,13)")
        other.catalog.save(folder)
    s.execute("drop(tbl,d.t)")
    with pytest.raises(CommandError):
        s.catalog.table("d.t")
