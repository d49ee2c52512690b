"""Factor codes, general grids and gathering by position."""

import random
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from huestrata.operators import positions
from huestrata.operators.positions import as_factor, expand_grid, gather_rows, level_table
from huestrata.sources import shared
from tests.test_plans import plan


def test_codes_of_repeated_and_missing_values(spark):
    rows = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5), ("b", 6)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(3)
    got = {r.n: r.Code for r in as_factor(df, "k").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: None, 5: 3, 6: 2}
    assert sorted(map(tuple, level_table(df, "k").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    given = {r.n: r.Code for r in as_factor(df, "k", levels=["c", "b"]).collect()}
    assert given == {1: 2, 2: None, 3: 2, 4: None, 5: 1, 6: 2}
    for bad in (["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            as_factor(df, "k", levels=bad)


def test_codes_replace_columns_and_keep_others(spark):
    df = spark.createDataFrame([(3.5, "x", 9), (float("nan"), "y", 9), (3.5, "x", 9)], "Code double, _level string, _code int")
    got = as_factor(df, "Code")
    assert got.columns == ["_level", "_code", "Code"]
    assert sorted(map(tuple, got.collect())) == [("x", 9, 1), ("x", 9, 1), ("y", 9, 2)]
    assert as_factor(df.limit(0), "Code").count() == 0


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_level_tables_are_broadcast_by_their_measured_size(spark, monkeypatch, most):
    monkeypatch.setattr(shared.broadcast_if_small, "__defaults__", (most,))
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        coded = as_factor(df, "k")
        assert ("BroadcastHashJoin" in plan(coded)) == bool(most)
        assert coded.agg(F.max("Code")).first()[0] == df.distinct().count()
        assert coded.filter("k = 0").select("Code").distinct().collect()[0][0] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grid_in_order_first_column_fastest(spark, monkeypatch):
    years = spark.createDataFrame([(2016,), (2014,), (2014,)], "y int").repartition(3)
    axes = {"Hour": range(8, 11), "Year": years, "Style": ["H", None, "Mean"], "Day": range(9, 0, -4), "b": [True]}
    want = [t[::-1] for t in product([True], [9, 5, 1], ["H", None, "Mean"], [2014, 2014, 2016], [8, 9, 10])]
    for inline in (positions.INLINE_VALUES, 0):
        monkeypatch.setattr(positions, "INLINE_VALUES", inline)
        grid = expand_grid(spark, axes)
        rows = sorted(map(tuple, grid.collect()))
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        assert [r[1:] for r in rows] == want
        assert grid.columns == ["Index", *axes]
    assert "CartesianProduct" not in plan(grid) and "BroadcastNestedLoopJoin" not in plan(grid)


def test_grid_limits(spark):
    assert expand_grid(spark, {"a": [1, 2], "b": []}).count() == 0
    assert [tuple(r) for r in expand_grid(spark, {"a": range(2**40, 2**40 + 1)}).collect()] == [(1, 2**40)]
    for bad in ({}, {"Index": [1]}, {"a": range(2**40), "b": range(2**40)}):
        with pytest.raises(ValueError):
            expand_grid(spark, bad)


def test_gather_repeats_order_and_positions_outside(spark, monkeypatch):
    monkeypatch.setattr(positions, "HOT_SHARE", 4)
    rng = random.Random(4)
    keys = rng.sample(range(1000), 40)
    rows = spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string").repartition(4)
    wanted = [rng.choice([1, 1, 1, 7, 40, 41, 0, -3, None, rng.randrange(1, 41)]) for _ in range(200)]
    requests = spark.createDataFrame(list(enumerate(wanted)), "n int, Index long").repartition(3)
    ordered = sorted(keys)
    full = [(i + 1, ordered[p - 1] if p and 1 <= p <= 40 else None) for i, p in enumerate(wanted)]
    got = gather_rows(rows, ["k"], requests, outside="null", request_order=["n"])
    assert sorted((r.Place, r.k) for r in got.collect()) == full
    inner = gather_rows(rows, ["k"], requests, request_order=["n"])
    assert sorted((r.Place, r.k) for r in inner.collect()) == [x for x in full if x[1] is not None]
    with pytest.raises(PySparkException):
        gather_rows(rows, ["k"], requests, outside="refuse").collect()
    inside = requests.filter("Index between 1 and 40")
    assert gather_rows(rows, ["k"], inside, outside="refuse").count() == inside.count()


def test_gather_of_ties_and_of_no_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    requests = spark.createDataFrame([(1,), (2,), (3,), (3,)], "Index long")
    assert sorted(r.v for r in gather_rows(rows, ["k"], requests).collect()) == ["a", "a", "b", "b"]
    assert gather_rows(rows, ["k"], requests.limit(0)).count() == 0
    assert gather_rows(rows.limit(0), ["k"], requests, outside="null").count() == 4
    with pytest.raises(ValueError):
        gather_rows(rows, ["k"], requests.withColumn("v", F.lit(1)))
    with pytest.raises(ValueError):
        gather_rows(rows, ["k"], requests, outside="keep")
