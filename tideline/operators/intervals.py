"""Interval algebra over long tables: one row for each interval, `start` < `end`, with key columns.

Everything is a sweep: +1 where an interval starts, -1 where it ends, a running
sum in between. To keep one long recording from being one task, time is cut into
cells of `cell` units and intervals into their parts in each cell. A cell needs
nothing of the others, so one shuffle by (keys, cell) serves every step within:
the union of each source's intervals, the depth, its labels, runs of one label.
A second one joins what cell borders have cut; only pieces at a border meet
there, two for each label and cell at most, so that a long recording's other
pieces stay spread. Without `cell` there is one cell, and no second shuffle.

The shuffles have a task for each TASK_POINTS points, which are counted before: what a task sorts doesn't
grow with the table. One cell of one recording is still one task's.

A cell should be longer than most intervals, as an interval makes a row for each
cell that it reaches into. Times may be whole numbers or doubles. Rows without
start < end (nulls, empty or reversed intervals) are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPEAKERS = ("non_speech", "one_spk", "two_spk", "three_spk")

#: Points that a task gets. Its sorts and windows hold up to 800 bytes a point at once.
TASK_POINTS = 500_000


def well_formed(iv: DataFrame) -> DataFrame:
    return iv.filter(F.col("start") < F.col("end"))


def cell_of(t: Column, size: int | float) -> Column:
    """The c with c * size <= t < (c + 1) * size, also where the quotient of doubles rounds past a border."""
    c, size = F.floor(t / F.lit(size)), F.lit(size)
    return F.when(c * size > t, c - 1).when((c + 1) * size <= t, c + 1).otherwise(c)


def last_cell_of(end: Column, size: int | float) -> Column:
    """The last cell that an interval with this end reaches into: c * size < end <= (c + 1) * size."""
    c, size = F.ceil(end / F.lit(size)) - 1, F.lit(size)
    return F.when(c * size >= end, c - 1).when((c + 1) * size < end, c + 1).otherwise(c)


def in_cells(iv: DataFrame, size: int | float, cell: str, *columns: str | Column) -> DataFrame:
    """columns, `cell`, start, end: each interval's part in each cell that it overlaps (not just touches)."""
    reach = F.sequence(cell_of(F.col("start"), size), last_cell_of(F.col("end"), size))
    parts = well_formed(iv).select(*columns, "start", "end", F.explode(reach).alias(cell))
    low, high = F.col(cell) * F.lit(size), (F.col(cell) + 1) * F.lit(size)
    return parts.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})


def _points(iv: DataFrame, keys: list[str], cell: int | float | None, source: str | None, role: int) -> DataFrame:
    """keys, _c, _role, _source, t, step: +1 and -1 of each part of each interval; role 1 are spans."""
    name = F.lit(None) if source is None else F.col(source)
    rows = iv.select(*keys, name.cast("string").alias("_source"), "start", "end")
    parts = well_formed(rows).withColumn("_c", F.lit(0).cast("long")) if cell is None else in_cells(rows, cell, "_c", *keys, "_source")
    step = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).cast("long").alias("step"))
    ends = F.explode(F.array(step("start", 1), step("end", -1))).alias("p")
    return parts.select(*keys, "_c", F.lit(role).alias("_role"), "_source", ends).select(*keys, "_c", "_role", "_source", "p.*")


def _changes(points: DataFrame, by: list[str]) -> DataFrame:
    """The points at which the union of a group's intervals begins (+1) or ends (-1)."""
    order = Window.partitionBy(*by).orderBy("t")
    last = points.withColumns({"_open": F.sum("step").over(order), "_after": F.lead("t").over(order)}).filter("_after is null or _after > t")
    active = last.withColumn("_on", (F.col("_open") > 0).cast("long"))
    return active.withColumn("step", F.col("_on") - F.coalesce(F.lag("_on").over(order), F.lit(0).cast("long"))).filter("step <> 0").drop("_open", "_after", "_on")


def _tasks(points: DataFrame) -> int | None:
    """Tasks that the points need; none for what fits into one, where Spark's own choice will do."""
    n = -(-points.count() // TASK_POINTS)
    return max(n, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else None


def _dealt(rows: DataFrame, tasks: int | None, by: list[str]) -> DataFrame:
    return rows.repartition(tasks, *by) if tasks else rows.repartition(*by)


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end: rows of one group that touch become one; they must not overlap."""
    order = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.col("start") > F.lag("end").over(order)).cast("int"), F.lit(1))
    run = rows.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(order))
    return run.groupBy(*by, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_isle")


def labelled_segments(
    iv: DataFrame, keys: list[str], labels: Callable[[Column], Column], spans: DataFrame | None = None, cell: int | float | None = None, source: str | None = None
) -> DataFrame:
    """keys, label, start, end: the longest stretches that have a label.

    `labels` gives the array of labels of a depth, which is the number of open
    intervals, or of sources with an open interval if `source` names their column.
    With spans (keys, start, end), only what lies inside them is labelled, and depth 0 too.
    """
    points = _points(iv, keys, cell, source, 0)
    if spans is not None:
        points = points.unionByName(_points(spans, keys, cell, None, 1))
    group = [*keys, "_c"]
    tasks = _tasks(points)
    points = _dealt(points, tasks, group)  # all that follows, up to the cell borders, keeps this layout
    if source is not None:
        points = _changes(points, [*group, "_role", "_source"])
    order = Window.partitionBy(*group).orderBy("t")
    total = lambda role: F.sum(F.when(F.col("_role") == role, F.col("step")).otherwise(F.lit(0).cast("long"))).over(order)
    run = points.withColumns({"_depth": total(0), "_inside": total(1), "end": F.lead("t").over(order)}).filter("t < end")
    named = F.when(F.col("_inside") > 0, labels(F.col("_depth"))) if spans is not None else F.when(F.col("_depth") > 0, labels(F.col("_depth")))
    pieces = run.select(*group, F.explode(named).alias("label"), F.col("t").alias("start"), "end")
    whole = _islands(pieces, [*group, "label"])
    if cell is None:
        return whole.select(*keys, "label", "start", "end")
    at_border = (F.col("start") <= F.col("_c") * F.lit(cell)) | (F.col("end") >= (F.col("_c") + 1) * F.lit(cell))
    whole = _dealt(whole.withColumn("_g", F.when(~at_border, F.col("_c"))), tasks, [*keys, "_g"])
    return _islands(whole, [*keys, "_g", "label"]).select(*keys, "label", "start", "end")


def merge(iv: DataFrame, keys: list[str], cell: int | float | None = None) -> DataFrame:
    """keys, start, end: the union of each key's intervals; touching ones join."""
    return labelled_segments(iv, keys, lambda d: F.array(F.lit(1)), None, cell).drop("label")


def complement(removed: DataFrame, spans: DataFrame, keys: list[str], cell: int | float | None = None) -> DataFrame:
    """keys, start, end: what the removed intervals leave of each key's spans; they may overlap, touch or lie outside."""
    return labelled_segments(removed, keys, lambda d: F.when(d == 0, F.array(F.lit(0))), spans, cell).drop("label")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], cell: int | float) -> DataFrame:
    """keys, start, end of every pair's common part; touching intervals have none.

    Both sides go to the cells they reach into and meet on (keys, cell); a pair
    counts in the cell in which its common part starts.
    """

    def spread(iv: DataFrame, s: str, e: str) -> DataFrame:
        cells = F.explode(F.sequence(cell_of(F.col("start"), cell), last_cell_of(F.col("end"), cell)))
        return well_formed(iv).select(*keys, F.col("start").alias(s), F.col("end").alias(e), cells.alias("_c"))

    both = spread(a, "s0", "e0").join(spread(b, "s1", "e1"), [*keys, "_c"])
    start, end = F.greatest("s0", "s1"), F.least("e0", "e1")
    return both.filter((start < end) & (cell_of(start, cell) == F.col("_c"))).select(*keys, start.alias("start"), end.alias("end"))


def active_classes(iv: DataFrame, spans: DataFrame, keys: list[str], source: str, most: int, cell: int | float | None = None) -> DataFrame:
    """keys, cls (number of sources active at once, `most` at most), start, end; the classes tile each span.

    However many of its intervals are open, a source counts once.
    """
    out = labelled_segments(iv, keys, lambda d: F.array(F.least(d, F.lit(most).cast("long"))), spans, cell, source)
    return out.withColumnRenamed("label", "cls")


def speaker_labels(iv: DataFrame, spans: DataFrame, keys: list[str], source: str, sources: int, cell: int | float | None = None) -> DataFrame:
    """keys, label, start, end with labels non_speech, one_spk, two_spk; for three sources also three_spk and two_or_three_spk."""

    def labels(depth: Column) -> Column:
        name = F.get(F.array(*map(F.lit, SPEAKERS[: sources + 1])), F.least(depth, F.lit(sources)).cast("int"))
        return F.array(name) if sources < 3 else F.when(depth > 1, F.array(name, F.lit("two_or_three_spk"))).otherwise(F.array(name))

    return labelled_segments(iv, keys, labels, spans, cell, source)
