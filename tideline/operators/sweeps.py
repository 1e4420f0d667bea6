"""Interval sweeps whose slices follow the data: no cell is guessed, and a busy hour of one recording is many tasks.

The results are those of `intervals`. Ends of intervals are points (keys, t) with a step; equal points
are added up first. Points are put into ranges of (keys, t) of about the same number of rows and written
once. What a range has to know of the others is the depth it begins with and the end of what it leaves
open. Ranges are contiguous, so that concerns one key at each border: fewer rows than twice the ranges,
times the labels that hold at once.

Rows without start < end (nulls, empty or reversed intervals) are left out; a null key is a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.intervals import well_formed
from tideline.operators.steps import settle


def _points(iv: DataFrame, keys: list[str], role: str) -> DataFrame:
    """keys, t, _open, _in: +1 and -1 in the role's column."""
    point = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).cast("long").alias("step"))
    rows = well_formed(iv).select(*keys, F.explode(F.array(point("start", 1), point("end", -1))).alias("p"))
    step = lambda r: (F.col("p.step") if r == role else F.lit(0).cast("long")).alias(r)
    return rows.select(*keys, "p.t", step("_open"), step("_in"))


def sliced(points: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """keys, t, _open, _in, _slice: equal points as one, in ranges of (keys, t) of about the same size; written."""
    net = points.groupBy(*keys, "t").agg(F.sum("_open").alias("_open"), F.sum("_in").alias("_in")).filter("_open <> 0 or _in <> 0")
    return settle(net.repartitionByRange(slices, *keys, "t").withColumn("_slice", F.spark_partition_id()))


def _carried(cut: DataFrame, keys: list[str]) -> DataFrame:
    """_slice, keys, _open0, _in0: what is open where a slice begins within a key; one row a slice at most."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_slice", *keys).agg(F.sum("_open").alias("_open"), F.sum("_in").alias("_in"))
    return sums.select("_slice", *keys, F.sum("_open").over(before).alias("_open0"), F.sum("_in").over(before).alias("_in0")).filter("_open0 is not null")


def _changes(cut: DataFrame, keys: list[str], slices: int, named: Callable[[Column, Column], Column]) -> DataFrame:
    """_slice, keys, label, t, begins, _next, _last: where a label begins or ends, with the label's neighbours in the slice."""
    carry = _carried(cut, keys).select(F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_open0", "_in0")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_slice") == F.col("_s"))
    rows = cut.repartitionById(slices, "_slice").join(F.broadcast(carry), same, "left")  # one row a slice
    order = Window.partitionBy("_slice", *keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    after = lambda c: F.sum(c).over(order) + F.coalesce(f"{c}0", F.lit(0).cast("long"))
    depths = rows.select("_slice", *keys, "t", "_open", "_in", after("_open").alias("_open1"), after("_in").alias("_in1"))
    now, then = named(F.col("_open1"), F.col("_in1")), named(F.col("_open1") - F.col("_open"), F.col("_in1") - F.col("_in"))
    labels = depths.select("_slice", *keys, "t", now.alias("_now"), then.alias("_then"))
    marked = lambda a, b, begins: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("label"), F.lit(begins).alias("begins")))
    changes = labels.select("_slice", *keys, "t", F.explode(F.concat(marked("_now", "_then", True), marked("_then", "_now", False))).alias("c"))
    each = Window.partitionBy("_slice", *keys, "label").orderBy("t")
    return changes.select("_slice", *keys, "t", "c.*").withColumns({"_next": F.lead("t").over(each), "_last": F.lag("t").over(each)})


def labelled_segments(
    iv: DataFrame, keys: list[str], labels: Callable[[Column], Column], spans: DataFrame | None = None, source: str | None = None, slices: int | None = None
) -> DataFrame:
    """keys, label, start, end: the longest stretches that have a label, as by `intervals.labelled_segments`.

    slices: ranges of points, as many as shuffle partitions by default. Points are written to the shared folder.
    """
    if source is not None:
        iv = merge(iv, [*keys, source], slices)
    points = _points(iv, keys, "_open")
    if spans is not None:
        points = points.unionByName(_points(spans, keys, "_in"))
    slices = slices or int(iv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = sliced(points, keys, slices)

    def named(depth: Column, inside: Column) -> Column:
        return F.coalesce(F.when(inside > 0 if spans is not None else depth > 0, labels(depth)), F.array())

    changes = _changes(cut, keys, slices, named)
    whole = changes.filter("begins and _next is not null").select(*keys, "label", F.col("t").alias("start"), F.col("_next").alias("end"))
    order = Window.partitionBy(*keys, "label").orderBy("_slice", "t")
    borders = changes.filter("begins and _next is null or not begins and _last is null")
    crossing = borders.withColumn("end", F.lead("t").over(order)).filter("begins").select(*keys, "label", F.col("t").alias("start"), "end")
    return whole.unionByName(crossing)


def merge(iv: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """keys, start, end: the union of each key's intervals; touching ones join."""
    return labelled_segments(iv, keys, lambda d: F.array(F.lit(1)), slices=slices).drop("label")


def complement(removed: DataFrame, spans: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """keys, start, end: what the removed intervals leave of each key's spans."""
    return labelled_segments(removed, keys, lambda d: F.when(d == 0, F.array(F.lit(0))), spans, slices=slices).drop("label")


def intersect_sets(sets: list[DataFrame], keys: list[str], slices: int | None = None) -> DataFrame:
    """keys, start, end: what the unions of all sets have in common (each set: keys, start, end)."""
    own = [s.select(*keys, F.lit(i).alias("_set"), "start", "end") for i, s in enumerate(sets)]
    all_open = lambda d: F.when(d == len(sets), F.array(F.lit(1)))
    return labelled_segments(reduce(DataFrame.unionByName, own), keys, all_open, source="_set", slices=slices).drop("label")


def active_classes(iv: DataFrame, spans: DataFrame, keys: list[str], source: str, most: int, slices: int | None = None) -> DataFrame:
    """keys, cls (number of sources active at once, `most` at most), start, end; the classes tile each span."""
    out = labelled_segments(iv, keys, lambda d: F.array(F.least(d, F.lit(most).cast("long"))), spans, source, slices)
    return out.withColumnRenamed("label", "cls")
