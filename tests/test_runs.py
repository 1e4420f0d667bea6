"""Observed stages count what separate counts find, in no further job; stopped runs of parts go on where they stopped."""

import os

import pytest
from pyspark.sql import functions as F

from tideline.operators.runs import Run
from tideline.sources import parts


def jobs(spark, group, act):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_observed_counts_without_further_jobs(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a.b"), (F.col("id") % 10).alias("c`d"), F.lit(None).cast("int").alias("e")).repartition(5)
    _, plain = jobs(spark, "plain", lambda: df.write.parquet(str(tmp_path / "plain")))
    run = Run(spark, "r")
    errors = {"big": F.col("`c``d`") > 7, "unknown": F.col("e") > 0}
    out, observed = jobs(spark, "observed", lambda: run.stage("one", df, errors, str(tmp_path / "one")))
    assert observed == plain and out.count() == 1000
    two = run.stage("two", out.filter("`c``d` > 100"))
    run.stage("three", two.limit(0))
    got = {(r.position, r.stage, r.kind, r.name): r.n for r in run.table().collect()}
    nulls = out.filter(F.col("`a.b`").isNull()).count()
    assert got[1, "one", "rows", None] == 1000 and got[1, "one", "nulls", "a.b"] == nulls and got[1, "one", "nulls", "e"] == 1000
    assert got[1, "one", "errors", "big"] == out.filter("`c``d` > 7").count() and got[1, "one", "errors", "unknown"] == 0
    assert {v for k, v in got.items() if k[0] > 1} == {0} and len(got) == 6 + 4 + 4
    run.save(str(tmp_path / "runs")), Run(spark, "s").save(str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == len(got)


def content(df):
    return sorted(map(tuple, df.select("part", "id", "x").collect()))


@pytest.fixture
def rows(spark):
    return spark.range(100).select("id", (F.col("id") * 3).alias("x"))


def test_a_stopped_run_goes_on(spark, rows, tmp_path):
    once, path = str(tmp_path / "once"), str(tmp_path / "twice")
    want = content(parts.write_parts_once(rows, once, ["id"], 15, wave=2))
    assert want == [(i // 15 + 1, i, 3 * i) for i in range(100)]
    made = []

    def work(d, stop=None):
        made.append(sorted(r.part for r in d.select("part").distinct().collect()))
        fail = F.when(F.col("part") == stop, F.raise_error(F.lit("killed"))).cast("long") if stop else None
        return d if fail is None else d.withColumn("x", F.coalesce(fail, F.col("x")))

    with pytest.raises(Exception, match="killed"):
        parts.write_parts_once(rows, path, ["id"], 15, lambda d: work(d, 6), wave=2)
    assert made == [[1, 2], [3, 4], [5, 6]] and {r.part for r in parts.manifest(spark, path).collect()} == {1, 2, 3, 4}
    assert len(os.listdir(f"{path}/data")) == 3  # the last one is not listed
    made.clear()
    assert content(parts.write_parts_once(rows, path, ["id"], 15, work, wave=2)) == want and made == [[5, 6], [7]]
    assert len(os.listdir(f"{path}/data")) == 4
    made.clear()
    assert content(parts.write_parts_once(rows.repartition(7), path, ["id"], 15, work, wave=2)) == want and made == []


def test_changed_input_makes_its_parts_anew(spark, rows, tmp_path):
    path, made = str(tmp_path), []

    def work(d):
        made.extend(sorted(r.part for r in d.select("part").distinct().collect()))
        return d

    parts.write_parts_once(rows, path, ["id"], 15, work)
    made.clear()
    other = rows.withColumn("x", F.when(F.col("id") == 40, None).otherwise(F.col("x")))
    assert content_of_null(parts.write_parts_once(other, path, ["id"], 15, work)) == [(3, 40)] and made == [3]
    made.clear()
    shorter = parts.write_parts_once(other.filter("id < 50"), path, ["id"], 15, work)
    assert made == [4] and shorter.count() == 50 and {r.part for r in parts.manifest(spark, path).collect()} == {1, 2, 3, 4}
    assert {r.part for r in parts.read_parts(spark, path, first=2).select("part").collect()} == {1, 2}
    made.clear()
    parts.write_parts_once(other.filter("id < 50"), path, ["id"], 15, work, version="2")
    assert made == [1, 2, 3, 4]


def content_of_null(df):
    return [(r.part, r.id) for r in df.filter("x is null").collect()]


def test_no_parts(spark, rows, tmp_path):
    with pytest.raises(FileNotFoundError):
        parts.write_parts_once(rows.limit(0), str(tmp_path), ["id"], 15)


def test_jobs_and_files_do_not_grow_with_the_parts(spark, tmp_path, monkeypatch):
    def made(n, path):
        df = spark.range(n).select("id", (F.col("id") * 3).alias("x"))
        out, n_jobs = jobs(spark, path, lambda: parts.write_parts_once(df, path, ["id"], 2))
        assert content(out) == [(i // 2 + 1, i, 3 * i) for i in range(n)]
        assert [r.id for r in parts.read_parts(spark, path, first=3).orderBy("id").collect()] == list(range(6))
        return n_jobs, sum(f.endswith(".parquet") for _, _, files in os.walk(f"{path}/data") for f in files)

    monkeypatch.setattr(parts, "WAVES", 2)
    few, many = made(400, str(tmp_path / "few")), made(2000, str(tmp_path / "many"))
    assert many[0] <= few[0] + 8 and many[1] <= few[1] + 8 and many[1] < 50  # 200 and 1000 parts
