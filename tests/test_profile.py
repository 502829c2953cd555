"""Exact and merged column profiles on values that are hard to count."""

import math

import pytest
from pyspark.sql import functions as F

from carelake.operators import profile

SCHEMA = "`a b` int, x double, m map<string,array<int>>, l array<int>, s struct<p:string,q:string>, t string, d date, n string"
ROWS = [(1, 0.0, {"u": [1], "v": [2]}, [1, None], (None, "z"), "9", None, None),
        (2, -0.0, {"v": [2], "u": [1]}, [None, 1], ("z", None), "10", None, None),
        (2, math.nan, {"u": [1], "v": None}, [1], None, "", None, None),
        (None, math.nan, None, None, (None, None), None, None, None)]


def rows_of(df):
    return {r.column_name: r for r in df.collect()}


def test_exact(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = rows_of(profile.column_profile({"t": df}, {"a b": "number"}))
    assert [got[c].distinct_count for c in df.columns] == [2, 2, 2, 3, 3, 3, 0, 0]
    assert [got[c].null_count for c in df.columns] == [1, 0, 1, 1, 1, 1, 4, 4]
    assert (got["a b"].description, got["a b"].min_value, got["a b"].max_value) == ("number", "1", "2")
    assert (got["t"].min_value, got["t"].max_value, got["m"].min_value, got["n"].max_value) == ("", "9", None, None)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert all(r.row_count == r.null_count == r.distinct_count == 0 for r in profile.column_profile({"t": df}).collect())
    both = profile.sketch_profile(profile.merged(profile.sketches({"t": df}), profile.sketches({"t": df})))
    assert all(r.row_count == 0 and r.distinct_count == 0 and r.median is None for r in both.collect())


def test_one_distinct_value_leaves_a_task_once(spark):
    df = spark.range(0, 40_000, numPartitions=2).select((F.col("id") % 3).alias("a"), F.lit("same").alias("b"))
    plan = profile.column_profile({"t": df})._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan
    assert {r.column_name: r.distinct_count for r in profile.column_profile({"t": df}).collect()} == {"a": 3, "b": 1}


def test_merged_loads_are_close_to_the_whole(spark):
    df = spark.range(60_000).select(F.col("id"), (F.col("id") % 7000).cast("decimal(10,2)").alias("v"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("t"))
    loads = [profile.sketches({"t": df.where(f"id % 3 = {i}")}) for i in range(3)]
    got, exact = rows_of(profile.sketch_profile(profile.merged(*loads))), rows_of(profile.column_profile({"t": df}))
    for c in df.columns:
        assert got[c].distinct_count == pytest.approx(exact[c].distinct_count, rel=0.06)
        assert (got[c].row_count, got[c].min_value, got[c].max_value) == (60_000, exact[c].min_value, exact[c].max_value)
    assert got["id"].median == pytest.approx(30_000, rel=0.05) and got["t"].median is None
