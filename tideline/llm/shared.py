"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.steps import Steps, settle, shared_dir

__all__ = ["Steps", "fresh", "look_up", "only", "settle", "shared_dir", "small_batches", "text_or_empty"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, whatever their names, don't reach an operator's working tables."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that df doesn't have (nor any that differs in case only)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner", share: int = 512) -> DataFrame:
    """rows joined with a settled table of one row a key, where one key may hold any part of the rows.

    The table's column `n` tells about how many rows have its key, and goes. A key
    of more than 1/share of their sum comes several times, and the rows go to its
    copies by a hash of their `spread` columns, so that no key fills a task. What
    is broadcast is a number for each of those keys, fewer than `share` of them.
    """
    copies, salt = fresh(rows, "_copies", "_salt")
    total = table.agg(F.sum(n)).first()[0] or 0
    part = max(1, -(-total // share))
    times = F.ceil(F.col(n) / part)
    hot = table.filter(F.col(n) > part).select(*keys, times.alias(copies))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(copies).isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col(copies)))).drop(copies)
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(times, F.lit(1)) - 1))).drop(n)
    # The hint keeps Spark from broadcasting a side whose size it takes from before the explode.
    return left.join(right.hint("merge"), [*keys, salt], how).drop(salt)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold `rows` rows at most from now on in this session.

    At Spark's own 10,000, one batch of long texts takes gigabytes in the JVM and
    again in the worker. The setting is read when a result is computed, long after
    the operator has returned, so it can't be put back. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
