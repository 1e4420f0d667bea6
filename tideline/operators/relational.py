"""Joins, unions, numbering and splits as the data preparation needs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import hash_bucket


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """left with the values of the first right row (by order) of its key; null where there is none."""
    first = right.groupBy(key).agg(F.min(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values])).alias("_f"))
    return left.join(first, key, "left").select(*[left[c] for c in left.columns], *[F.col(f"_f._{v}").alias(v) for v in values])


def without(df: DataFrame, errors: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the error lists."""
    listed = reduce(DataFrame.unionByName, [e.select(key) for e in errors]).distinct()
    return df.join(listed, key, "left_anti")


def without_each(df: DataFrame, unaligned: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is in the unaligned list: one anti join a key."""
    for key in keys:
        df = df.join(unaligned.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return df


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that some frames lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numbered_batches(df: DataFrame, order: list[str], rows: int, bucket_rows: int = 100_000, most: int = 16_384, total: int | None = None) -> DataFrame:
    """df with `part`, from 1: batches of `rows` rows in the given order, no empty last one.

    The first order column must be a number. Rows are numbered within ranges of
    it, of about `bucket_rows` rows (and `most` ranges), and by the ranges' sizes, so no task sees all of them.
    total: the number of rows, if it is known.
    """
    key = F.col(order[0])
    buckets = max(16, min(most, (df.count() if total is None else total) // bucket_rows))
    cuts = df.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)], 20 * buckets).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    side = max(1, int(len(cuts) ** 0.5))
    outer = cuts[side - 1 :: side]
    inner = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]
    below = lambda xs, c: F.size(F.filter(xs, lambda x: x < c)) if len(cuts) else F.lit(0)
    kind = df.schema[order[0]].dataType
    array = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]) if xs else F.array().cast(f"array<{kind.simpleString()}>")
    coarse = below(array(outer), key)
    ranged = df.withColumn("_i", coarse).withColumn("_b", F.col("_i") * (side + 1) + below(F.get(F.array(*[array(x) for x in inner], array([])), F.col("_i")), key))
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    numbered = ranged.withColumn("_at", at).join(F.broadcast(sizes), "_b")  # one row a range
    return numbered.withColumn("part", F.floor((F.col("_at") - 1 + F.col("_before")) / rows) + 1).drop("_i", "_b", "_at", "_before")


def hash_split(df: DataFrame, key: Column, upto: int, inside: str, outside: str, column: str = "split") -> DataFrame:
    """df with a split that depends on the key alone: buckets 0 to upto of ten are `inside`."""
    return df.withColumn(column, F.when(hash_bucket(key) <= upto, inside).otherwise(outside))


def modelling_dataset(df: DataFrame, category: str, key: Column, training: dict[str, int], testing: list[str]) -> DataFrame:
    """Rows of the training categories split into training and evaluation, those of the testing ones marked as test; others go."""
    parts = [hash_split(df.filter(F.col(category) == c), key, h, "training", "evaluation") for c, h in training.items()]
    return union_all([*parts, df.filter(F.col(category).isin(testing)).withColumn("split", F.lit("test"))])


def percent_of_total(df: DataFrame, *by: str) -> DataFrame:
    """by, n, percent of all rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))  # one row


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, n: equal widths between the least and the greatest value; the last bin is closed; one value only is bin 0. Nulls don't count."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    x = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x")).crossJoin(F.broadcast(ends))  # one row
    bin_ = F.coalesce(F.floor(F.try_divide((F.col("_x") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0))
    return x.groupBy(F.least(bin_, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def quality_flags(df: DataFrame, rate: int, longest: float, kind: str = "WAV") -> DataFrame:
    """df with bad_type, bad_rate, bad_channels, bad_duration and bad (any); a null counts as bad."""
    no = lambda c: F.coalesce(~c, F.lit(True))
    flags = {
        "bad_type": no(F.col("file_type") == kind),
        "bad_rate": no(F.col("sampling_rate") == rate),
        "bad_channels": no(F.col("channels") == 1),
        "bad_duration": no((F.col("duration") > 0) & (F.col("duration") <= longest)),
    }
    return df.withColumns(flags).withColumn("bad", reduce(lambda a, b: a | b, map(F.col, flags)))


def quality_report(flagged: DataFrame) -> DataFrame:
    """One row: files and how many fail each test."""
    names = ["bad_type", "bad_rate", "bad_channels", "bad_duration", "bad"]
    return flagged.agg(F.count("*").alias("n_files"), *[F.count_if(F.col(n)).alias(f"n_{n}") for n in names])
