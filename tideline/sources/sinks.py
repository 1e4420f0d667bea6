"""Writers: numbered parts, CSV with lists as JSON, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.relational import numbered_batches


def write_parts(df: DataFrame, path: str, order: list[str], rows: int) -> None:
    """Parquet in folders part=1, 2, ... of `rows` rows each in the given order."""
    numbered_batches(df, order, rows).write.mode("overwrite").partitionBy("part").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").csv(path, header=True)


def parquet_to_csv(spark, source: str, target: str) -> None:
    write_csv(spark.read.parquet(source), target)


def write_report(df: DataFrame, path: str) -> None:
    """Each row as a JSON line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
