import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lamina.operators.filters import EXCLUDED, INCLUDED, Bound, Filter, Range, TableFilter


def model(f: Filter, v):
    if f.all:
        return True
    if f.only_null:
        return v is None
    if f.none:
        return False
    if v is None:
        return f.allow_null
    if f.ranges:
        def inside(r):
            low = r.lower.value is None or (v >= r.lower.value if r.lower.kind == INCLUDED else v > r.lower.value)
            return low and (r.upper.value is None or (v <= r.upper.value if r.upper.kind == INCLUDED else v < r.upper.value))
        return any(map(inside, f.ranges))
    return bool(f.included) and v in f.included or bool(f.excluded) and v not in f.excluded


def made(rng):
    value = lambda: rng.choice([-(2**63), -5, -1, 0, 1, 3, 7, 2**63 - 1])
    kind = rng.choice(["all", "none", "only_null", "ranges", "ranges", "discrete", "discrete"])
    null = rng.random() < 0.5
    if kind in ("all", "none", "only_null"):
        return Filter(**{kind: True})
    if kind == "ranges":
        return Filter(tuple(Range.of(rng.choice([None, value()]), rng.choice([None, value()]), rng.random() < 0.5, rng.random() < 0.5) for _ in range(rng.randint(1, 3))), allow_null=null)
    return Filter(included=tuple({value() for _ in range(rng.randint(0, 2))}), excluded=tuple({value() for _ in range(rng.randint(0, 2))}), allow_null=null)


def test_against_model(spark):
    rng = random.Random(1)
    values = [None, -(2**63), -5, -2, -1, 0, 1, 2, 3, 7, 8, 2**63 - 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    filters = [made(rng) for _ in range(60)]
    got = df.select("i", *[F.coalesce(f.condition(F.col("v")), F.lit(False)).alias(f"f{k}") for k, f in enumerate(filters)]).orderBy("i").collect()
    for k, f in enumerate(filters):
        assert [r[f"f{k}"] for r in got] == [model(f, v) for v in values], f


def test_block_verdicts():
    rng = random.Random(2)
    for _ in range(400):
        f = made(rng)
        block = [rng.choice([None, -5, -1, 0, 1, 3, 7]) for _ in range(rng.randint(1, 4))]
        known = [v for v in block if v is not None]
        said = f.matches(min(known, default=None), max(known, default=None), block.count(None), len(block))
        hits = sum(model(f, v) for v in block)
        assert said != "none" or hits == 0
        assert said != "all" or hits == len(block)


def test_block_verdicts_as_expression(spark):
    rng = random.Random(3)
    blocks = [[rng.choice([None, -5, -1, 0, 1, 3, 7]) for _ in range(rng.randint(0, 4))] for _ in range(60)]
    figures = [(i, min([v for v in b if v is not None], default=None), max([v for v in b if v is not None], default=None), b.count(None), len(b)) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(figures, "i int, lo long, hi long, nulls long, n long").coalesce(1)
    filters = [made(rng) for _ in range(40)]
    got = df.select("i", *[f.verdict(F.col("lo"), F.col("hi"), F.col("nulls"), F.col("n")).alias(f"f{k}") for k, f in enumerate(filters)]).orderBy("i").collect()
    for k, f in enumerate(filters):
        assert [r[f"f{k}"] for r in got] == [f.matches(*x[1:]) for x in figures], f


def test_json_round_trip():
    t = TableFilter({"a": Filter((Range(Bound(INCLUDED, dt.date(2020, 1, 1)), Bound(EXCLUDED, dt.date(2021, 1, 1))),), allow_null=True), "b": Filter(included=(Decimal("1.50"), Decimal("2"))), "c": Filter(excluded=("x",)), "d": Filter(all=True), "e": Filter(included=(dt.datetime(2020, 1, 1, 5),))})
    assert TableFilter.from_json(t.to_json()) == t


def test_floats_in_order(spark):
    df = spark.createDataFrame([(x,) for x in (-2.5, -1.0, -0.0, 1.0, float("nan"))], "x double")
    assert [r.x for r in TableFilter({"x": Filter((Range.of(-2.0, 0.5),))}).apply(df).collect()] == [-1.0, -0.0]


def test_selectivity():
    half = Filter((Range.of(None, 50),))
    assert half.selectivity(0, 100, 0.0, 100) == 0.5
    assert Filter(included=(1, 2)).selectivity(0, 100, 0.0, 10) == 0.2
    assert Filter(only_null=True).selectivity(0, 1, 0.25, 2) == 0.25
    assert Filter((Range.of("a", "b"),)).selectivity("a", "z", 0.0, 5) == -1
    assert Filter((Range.of(5, 5),)).selectivity(5, 5, 0.0, 1) == 1.0


def test_bad_bounds():
    with pytest.raises(ValueError):
        Bound(INCLUDED)
    with pytest.raises(ValueError):
        Bound("OPEN", 1)


def test_pushed_down(spark):
    plan = TableFilter({"o_custkey": Filter((Range.of(None, 10),))}).apply(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_custkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
