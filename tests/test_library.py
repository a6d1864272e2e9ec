import itertools
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators.aggregates import Aggregate, aggregate
from lamina.operators.exchange import bucket_of
from lamina.operators.joins import Join, join
from lamina.plans import cost, layout, placement, planner
from lamina.plans.scheduling import Scheduler, Slots
from lamina.service import Service
from lamina.sources.catalog import Catalog, Layout, Manifest, Table
from lamina.sources.delimited import load, load_indexed
from lamina.sources.reader import Scan, scan
from lamina.types import schema_of


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3), (None, "x", 4), (5, "z", 5)], "k long, t string, v int")
    b = spark.createDataFrame([(1, "x", 10), (1, "x", 11), (2, None, 12), (None, "x", 13), (9, "q", 14)], "k long, t string, w int")
    return a, b


@pytest.mark.parametrize("kind", ["EQUI_INNER", "EQUI_LEFT", "EQUI_RIGHT", "EQUI_FULL"])
def test_joins_agree(sides, kind):
    a, b = sides
    results = set()
    for algorithm in ("AUTO", "BROADCAST", "PARTITIONED", "SORTED", "BROADCAST_CHAIN", "PARTITIONED_CHAIN"):
        got = join(a, b, Join([("k", "k"), ("t", "t")], kind, algorithm, [("v", "v")], [("w", "w")])).collect()
        results.add(tuple(sorted(map(str, got))))
    pairs = {(1, 10), (1, 11)}
    want = set(pairs)
    if kind in ("EQUI_LEFT", "EQUI_FULL"):
        want |= {(v, None) for v in (2, 3, 4, 5)}
    if kind in ("EQUI_RIGHT", "EQUI_FULL"):
        want |= {(None, w) for w in (12, 13, 14)}
    assert len(results) == 1 and {tuple(r) for r in got} == want


def test_join_with_equal_names(sides):
    a, b = sides
    assert join(a, b, Join([("k", "k")], left=[("t", "t")], right=[("t", "t2")])).columns == ["t", "t2"]
    with pytest.raises(ValueError):
        Join([], "EQUI_INNER")
    with pytest.raises(ValueError):
        Join([("k", "k")], "SEMI")


def test_too_large_to_broadcast(sides):
    a, b = sides
    plan = join(a, b, Join([("k", "k")], algorithm="BROADCAST"), limit=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "shuffle_hash" in plan


def test_aggregate_edges(spark):
    df = spark.createDataFrame([(None, None), (None, 1), ("a", None), ("b", 2**62)], "g string, x long")
    rows = {r.g: (r.s, r.n) for r in aggregate(df, Aggregate([("g", "g", True)], [("SUM", "x", "s"), ("COUNT", "x", "n")])).collect()}
    assert rows == {None: (1, 1), "a": (None, 0), "b": (2**62, 1)}
    assert aggregate(df.limit(0), Aggregate([], [("SUM", "x", "s"), ("COUNT", "*", "n")])).first().asDict() == {"s": None, "n": 0}
    with pytest.raises(Exception, match="(?i)overflow"):
        aggregate(df.union(df).where("g = 'b'"), Aggregate([], [("SUM", "x", "s")])).collect()
    with pytest.raises(ValueError):
        aggregate(df, Aggregate([], [("MEDIAN", "x", "m")]))


def test_buckets(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c")], "x string, y string")
    got = [r[0] for r in df.select(bucket_of(["x", "y"], 1 << 20)).collect()]
    assert got[0] != got[1] and got[2] is None


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1||x||2.5||\n2||||\\N||\n\\N||y||||\n4||z\n")
    rows = load(spark, str(tmp_path), schema_of("k:int,s:string,d:decimal(5,2)"), "||").collect()
    assert [(r.k, r.s, None if r.d is None else float(r.d)) for r in rows] == [(1, "x", 2.5), (2, "", None), (None, "y", None), (4, "z", None)]
    rows, entries = load_indexed(spark, str(tmp_path), schema_of("k:int,s:string,d:decimal(5,2)"), ["k"], 4, "||")
    with pytest.raises(Exception, match="null"):
        rows.collect()


def test_scan_options(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string").write.parquet(str(tmp_path / "t"))
    schema = schema_of("k:int,missing:string")
    assert sorted((tuple(r) for r in scan(spark, str(tmp_path / "t"), Scan(["missing", ("k", "key")], schema=schema)).collect()), key=str) == [(None, 1), (None, 2)]
    with pytest.raises(ValueError, match="missing"):
        scan(spark, str(tmp_path / "t"), Scan(schema=schema, tolerant=False))


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        m.read()
    m.append(spark.range(3))
    first = list(m.files())
    m.append(spark.range(3, 5))
    assert m.read().count() == 5 and m.read(1).count() == 3
    with pytest.raises(ValueError):
        m.swap(["nowhere"], [])
    spark.range(10).write.parquet(str(tmp_path / "n"))
    m.swap(first, [str(tmp_path / "n")])
    assert m.read().count() == 12 and m.clean() == first and m.read().count() == 12
    with pytest.raises(Exception):  # noqa: B017
        m.append(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")))
    assert m.read().count() == 12


def test_catalog():
    c = Catalog()
    c.create_schema("s")
    c.create_table("s", Table("t", {"a": "int"}))
    c.alter("s", "t", {"a": "int", "b": "int"}, 5)
    c.add_layout("s", "t", Layout(1, "p"))
    again = Catalog.from_json(c.to_json())
    assert again.table("s", "t").schema_at(5) == {"a": "int", "b": "int"} and again == c
    with pytest.raises(ValueError):
        c.create_table("s", Table("t", {}))
    with pytest.raises(KeyError):
        c.table("s", "u")


def test_cost_and_layout():
    small, large = cost.TableStats(10, 100), cost.TableStats(10**9, 1 << 40)
    assert cost.small_side(small, large) == "left" and cost.small_side(large, large) == "right"
    assert cost.algorithm(small, large) == "BROADCAST" and cost.algorithm(small, large, "EQUI_FULL") == "PARTITIONED"
    assert cost.split_size(64, 0.1, 1000) == 256 and cost.split_size(64, 0.9, 1000) == 64 and cost.split_size(64, 0.1, 100) == 100
    assert layout.projection(["z"], {"a": ["z", "y"], "b": ["z"]}) == "b"


def test_planner_swaps_sides(spark):
    nation, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("nation", "customer"))
    big = planner.BaseTable("c", orders, ["c_custkey", "c_nationkey"], stats=cost.TableStats(150, 10_000))
    tiny = planner.BaseTable("n", nation.where("n_nationkey < 5"), ["n_nationkey", "n_name"], stats=cost.TableStats(5, 100))
    for kind, how in (("EQUI_INNER", "inner"), ("EQUI_LEFT", "left"), ("EQUI_RIGHT", "right"), ("EQUI_FULL", "full")):
        tree = planner.JoinedTable(big, tiny, [("c_nationkey", "n_nationkey")], kind, left_columns=[("c_custkey", "c")], right_columns=[("n_name", "n")])
        want = orders.join(nation.where("n_nationkey < 5"), F.col("c_nationkey") == F.col("n_nationkey"), how).select("c_custkey", "n_name")
        got = planner.build(tree)
        assert got.columns == ["c", "n"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_splits_to_the_nearest_power_of_two():
    for size, split in ((128 / 14.5, 16), (128 / 12, 16), (128 / 11.9, 8), (128 / 8, 8), (1, 64), (128, 1), (1000, 1), (0, 64)):
        assert layout.cost_based_split({"a": size}, ["a"], 128, 64) == split


def test_cache_choices_are_exact():
    """Against all sets of columns, on small workloads."""
    r = random.Random(3)
    for _ in range(60):
        names = [("t", c) for c in "abcdef"]
        sizes = {c: r.randint(1, 6) for c in names}
        loads = [placement.Load(frozenset(r.sample(names, r.randint(1, 4))), r.randint(1, 5), r.randint(1, 9)) for _ in range(r.randint(0, 20))]
        budget = r.randint(0, 14)
        sets = [set(c) for n in range(7) for c in itertools.combinations(names, n) if sum(sizes[x] for x in c) <= budget]
        for choose, value in ((placement.most_coverage, lambda q: 1), (placement.cost_optimal, lambda q: q.cost * q.frequency)):
            worth = lambda held: sum(value(q) for q in loads if q.columns <= held)  # noqa: B023, E731
            got = choose(loads, sizes, budget)
            assert sum(sizes[x] for x in got) <= budget and worth(got) == max(map(worth, sets))


def test_rate_greedy_takes_columns():
    loads = [placement.Load(frozenset({("t", "a"), ("t", "b")}), 4), placement.Load(frozenset({("t", "c")}), 3)]
    assert placement.rate_greedy(loads, {("t", "a"): 1, ("t", "b"): 8, ("t", "c"): 2}, 4) == {("t", "a"), ("t", "c")}


def test_placement():
    assert placement.place({"t": ["a"]}, {"p": {"t": ["b"]}, "q": {"t": ["a", "b"]}}) == "q"
    loads = [placement.Load(frozenset({("t", c)}), 1, v) for c, v in (("a", 6), ("b", 5), ("c", 5))]
    sizes = {("t", "a"): 6, ("t", "b"): 5, ("t", "c"): 5}
    assert placement.cost_optimal(loads, sizes, 10) == {("t", "b"), ("t", "c")}


def test_scheduler():
    now = [0.0]
    s = Scheduler(Slots(1, 0), lambda: now[0])
    a, b, c = s.submit("x"), s.submit("y", "RELAXED"), s.submit("z", "BEST_EFFORT")
    assert [q.token for q in s.step()] == [a]
    now[0] = 10
    assert s.step() == []
    s.slots.give("cluster")
    now[0] = 20
    assert s.step() == []  # tried at 10, next at 40
    now[0] = 40
    assert [q.token for q in s.step()] == [b]
    s.slots.give("cluster")
    assert [q.token for q in s.step()] == [c]


def test_service(spark):
    c = Catalog()
    c.create_schema("s")
    c.create_table("s", Table("nation", {"n_nationkey": "int"}, [], [Layout(1, "/root/testdata/sf0.001/nation.parquet")]))
    c.peers["site"] = {"nation": ["n_name"]}
    service = Service(spark, c)
    service.use("s")
    assert service.place("SELECT n_name FROM nation") == "site" and service.place("SELECT n_name, n_regionkey FROM nation") == "cloud"
    token = service.submit("SELECT no_such FROM nation")
    assert service.status(token) == "FAILED"
    with pytest.raises(RuntimeError):
        service.result(token)
    assert service.result(service.submit("SELECT n_nationkey FROM nation ORDER BY 1", limit=2))[1] == [["0"], ["1"]]
    assert service.workload(["SELECT 1"])[0][1] >= 0


@pytest.mark.parametrize("sql", ["SELEC 1", "SELECT nothing FROM nation", "SELECT 1 FROM no_such_table"])
def test_bad_sql(spark, sql):
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("nation")
    with pytest.raises(Exception):  # noqa: B017
        spark.sql(sql)
