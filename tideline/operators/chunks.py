"""Fixed grids of chunks, and three rules for a chunk's class.

Intervals expand to the chunks they reach into by arithmetic, so chunks and
intervals meet on (keys, chunk) and no range join is needed. Time, whole units or
doubles, counts from each recording's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import round_half_even
from tideline.operators.intervals import in_cells


def grid(recordings: DataFrame, keys: list[str], duration: str, size: int | float, last: str = "drop") -> DataFrame:
    """keys, chunk. last: "drop" leaves out the last of ceil(duration / size), "full" keeps floor, "keep" keeps ceil."""
    n = F.floor(F.col(duration) / size) if last == "full" else F.ceil(F.col(duration) / size) - (1 if last == "drop" else 0)
    return recordings.withColumn("_n", n).filter("_n > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk"))


def overlaps(iv: DataFrame, keys: list[str], size: int | float, *more: str) -> DataFrame:
    """keys, more, chunk, start, end: each interval's part in each chunk it overlaps (not just touches)."""
    return in_cells(iv, size, "chunk", *keys, *more).select(*keys, *more, "chunk", "start", "end")


def label_durations(labelled: DataFrame, keys: list[str], size: int | float) -> DataFrame:
    """keys, chunk, label, duration: repeated (start, end) in a chunk count once, for the label that comes first."""
    parts = overlaps(labelled, keys, size, "label", "priority")
    once = parts.groupBy(*keys, "chunk", "start", "end").agg(F.min(F.struct("priority", "label")).alias("p"))
    return once.groupBy(*keys, "chunk", "p.priority", "p.label").agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


def tied_labels(labelled: DataFrame, chunks: DataFrame, keys: list[str], size: int | float) -> DataFrame:
    """keys, chunk, tied: the labels of the longest time in order of priority; an empty array if there are none."""
    sums = label_durations(labelled, keys, size)
    best = sums.groupBy(*keys, "chunk").agg(F.max("duration").alias("most"), F.collect_list(F.struct("priority", "label", "duration")).alias("all"))
    tied = F.transform(F.array_sort(F.filter("all", lambda x: x["duration"] == F.col("most"))), lambda x: x["label"])
    best = best.select(*keys, "chunk", tied.alias("tied"))
    return chunks.join(best, [*keys, "chunk"], "left").select(*keys, "chunk", F.coalesce("tied", F.array().cast("array<string>")).alias("tied"))


def majority(labelled: DataFrame, chunks: DataFrame, keys: list[str], size: int | float) -> DataFrame:
    """keys, chunk, label, n_tied: the label of the longest time; of several, that of the least priority. No labels: null."""
    return tied_labels(labelled, chunks, keys, size).select(*keys, "chunk", F.get("tied", 0).alias("label"), F.size("tied").alias("n_tied"))


def rounded_overlaps(iv: DataFrame, keys: list[str], size: float, decimals: int, *more: str) -> DataFrame:
    """As `overlaps`, with the chunks' borders rounded (as Python does) before anything is measured."""
    low, high = F.floor(F.col("start") / size) - 1, F.floor(F.col("end") / size) + 1
    rows = iv.withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), F.greatest(high, F.lit(0).cast("long")))))
    begin, end = (round_half_even((F.col("chunk") + i) * F.lit(float(size)), decimals) for i in (0, 1))
    parts = rows.select(*keys, *more, "chunk", F.greatest("start", begin).alias("start"), F.least("end", end).alias("end"))
    return parts.filter("start < end")


def sparse_rule(labelled: DataFrame, chunks: DataFrame, keys: list[str], size: int | float, decimals: int | None = None) -> DataFrame:
    """keys, chunk, label: non_speech if strictly longest, else one_spk if strictly longest, else two_spk (also for ties and empty chunks).

    decimals: times are seconds, and chunk borders are rounded to so many places first, as in the chunks' names. The parts
    of a label are then added up in order of their start, as sums of doubles depend on it.
    """
    if decimals is None:
        parts = overlaps(labelled, keys, size, "label").groupBy(*keys, "chunk")
        of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("end") - F.col("start"))), F.lit(0))
    else:
        parts = rounded_overlaps(labelled, keys, size, decimals, "label").groupBy(*keys, "chunk")
        own = lambda label: F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("start", "end"))))
        of = lambda label: F.aggregate(own(label), F.lit(0.0), lambda s, x: s + (x["end"] - x["start"]))
    sums = parts.agg(of("non_speech").alias("non"), of("one_spk").alias("one"), of("two_spk").alias("two"))
    label = F.when((F.col("non") > F.col("one")) & (F.col("non") > F.col("two")), "non_speech").when((F.col("one") > F.col("non")) & (F.col("one") > F.col("two")), "one_spk").otherwise("two_spk")
    return chunks.join(sums, [*keys, "chunk"], "left").select(*keys, "chunk", label.alias("label"))


def overlap_count(iv: DataFrame, chunks: DataFrame, keys: list[str], size: int | float, most: int = 2) -> DataFrame:
    """keys, chunk, label: the number of intervals (not sources) that strictly overlap the chunk, `most` at most."""
    counts = overlaps(iv, keys, size).groupBy(*keys, "chunk").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))
    return chunks.join(counts, [*keys, "chunk"], "left").select(*keys, "chunk", F.coalesce("n", F.lit(0)).alias("label"))


def labels_in_chunks(labelled: DataFrame, keys: list[str], size: int | float) -> DataFrame:
    """keys, chunk, label, start, end of the closed-overlap rule: parts of zero length go, exact repeats keep the first label."""
    parts = overlaps(labelled, keys, size, "label", "priority")
    first = F.row_number().over(Window.partitionBy(*keys, "chunk", "start", "end").orderBy("priority", "label"))
    return parts.withColumn("_n", first).filter("_n = 1").select(*keys, "chunk", "label", "start", "end")
