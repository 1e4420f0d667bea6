"""Confusion matrices and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n of the rows that have both."""
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """truth, then pred_<class> for each class; classes that never occur as truth have no row."""
    columns = [F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes]
    return pairs.groupBy("truth").agg(*columns)


def class_scores(pairs: DataFrame) -> DataFrame:
    """cls, precision, recall, f1, support for each class seen on either side; a ratio over nothing is 0."""
    seen = F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x")
    sides = pairs.select("n", (F.col("truth") == F.col("predicted")).alias("hit"), seen)
    sums = sides.groupBy(F.col("x.c").alias("cls")).agg(
        F.sum(F.col("n") * F.col("x.t")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("guessed"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("hits")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    scored = sums.withColumns({"precision": ratio(F.col("hits"), F.col("guessed")), "recall": ratio(F.col("hits"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("cls", "precision", "recall", f1.alias("f1"), "support", "hits")


def classification_report(pairs: DataFrame) -> DataFrame:
    """name, precision, recall, f1, support: each class, then accuracy (as f1), macro avg and weighted avg."""
    scores = class_scores(pairs)
    total = F.sum("support")
    weigh = lambda c: F.sum(F.col(c) * F.col("support")) / total
    sums = scores.agg(
        (F.sum("hits") / total).alias("accuracy"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[weigh(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")], total.alias("support")
    )
    none = F.lit(None).cast("double")
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
    rows = [row("accuracy", none, none, F.col("accuracy")), row("macro avg", *[F.col(f"m_{c}") for c in ("precision", "recall", "f1")]), row("weighted avg", *[F.col(f"w_{c}") for c in ("precision", "recall", "f1")])]
    averages = sums.filter("support is not null").select(F.explode(F.array(*rows)).alias("r"), "support").select("r.*", "support")
    return scores.select(F.col("cls").cast("string").alias("name"), "precision", "recall", "f1", "support").unionByName(averages)
