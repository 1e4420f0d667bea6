"""Sweeps in slices against the sweeps in cells, and their balance on a hot recording."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals, sweeps


def rows_of(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc") if i % 3 else None, rng.choice("xyz"), s := rng.randrange(400), s + rng.randrange(-1, 40)) for i in range(500)]
    iv = spark.createDataFrame([*rows, ("a", "x", None, 5), ("a", None, 7, 900)], "k string, source string, start long, end long")
    return iv, spark.createDataFrame([("a", 0, 300), ("a", 310, 420), ("b", 50, 60), ("d", 0, 9)], "k string, start long, end long")


@pytest.mark.parametrize("slices", [1, 4, 23])
def test_same_as_by_cells(made, slices):
    iv, spans = made
    columns = ["k", "start", "end"]
    assert rows_of(sweeps.merge(iv, ["k"], slices), *columns) == rows_of(intervals.merge(iv, ["k"]), *columns)
    known = iv.filter("k is not null and source is not null")
    assert rows_of(sweeps.complement(known, spans, ["k"], slices), *columns) == rows_of(intervals.complement(known, spans, ["k"]), *columns)
    got = sweeps.active_classes(known, spans, ["k"], "source", 2, slices)
    assert rows_of(got, "k", "cls", "start", "end") == rows_of(intervals.active_classes(known, spans, ["k"], "source", 2), "k", "cls", "start", "end")
    two = lambda d: F.when(d > 1, F.array(F.lit("two"), F.lit("many"))).otherwise(F.array(F.lit("one")))
    got = sweeps.labelled_segments(known, ["k"], two, None, "source", slices)
    assert rows_of(got, "k", "label", "start", "end") == rows_of(intervals.labelled_segments(known, ["k"], two, None, None, "source"), "k", "label", "start", "end")
    sides = [intervals.merge(known.filter(F.col("source") == s), ["k"]) for s in "xy"]
    assert rows_of(sweeps.intersect_sets(sides, ["k"], slices), *columns) == rows_of(intervals.intersect(*sides, ["k"], 50), *columns)


def test_empty(made):
    iv, spans = made
    assert sweeps.merge(iv.limit(0), ["k"], 3).count() == 0
    assert sweeps.complement(iv.limit(0), spans, ["k"], 3).count() == 4


def test_a_busy_hour_is_many_tasks(spark):
    """A third of all intervals lie in one hour of one recording, many of them at the same instant."""
    hot = spark.range(10000).select(F.lit(7).cast("long").alias("k"), (F.col("id") * 360 + 10_000_000).alias("start"))
    tied = spark.range(5000).select(F.lit(7).cast("long").alias("k"), F.lit(10_000_100).cast("long").alias("start"))
    rest = spark.range(30000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 800_000_000).alias("start"))
    iv = hot.union(tied).union(rest).withColumn("end", F.col("start") + 300)
    cut = sweeps.sliced(sweeps._points(iv, ["k"], "_open"), ["k"], 24)
    sizes = sorted(r["count"] for r in cut.groupBy("_slice").count().collect())
    assert len(sizes) == 24 and sizes[-1] < 2 * sizes[12]
    tasks = cut.repartitionById(24, "_slice").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in tasks) == sizes
    assert sweeps._carried(cut, ["k"]).count() < 24
    plan = sweeps._changes(cut, ["k"], 24, lambda d, i: F.array(d))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_slice" not in plan.split("BroadcastExchange")[0]
    assert rows_of(sweeps.merge(iv, ["k"], 24), "k", "start", "end") == rows_of(intervals.merge(iv, ["k"], 3_600_000), "k", "start", "end")
