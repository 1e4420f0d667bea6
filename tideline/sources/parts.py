"""Numbered parts that are made once: a run that was stopped goes on where it stopped, a changed input makes its parts anew.

A folder holds data (`data/attempt=.../`, rows with `part`, in whose order each file is) and a manifest, one file for
each wave of parts that has been written in full. A file holds many parts: a folder for each would cost a rename and a
listing on the driver for every few rows. A part counts only once the manifest lists it, with its rows and the digest of its input;
what a stopped run left behind isn't listed, and the next run deletes it. One run at a time may write a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.relational import numbered_batches
from tideline.operators.steps import settle, shared_dir

#: Waves of a run at most, where the caller doesn't say how many parts one has.
WAVES = 16
#: Goes into the digests: parts that were written in folders of their own are made anew.
_LAYOUT = "rows"
_MANIFEST = "part long, n long, digest string, attempt string, at long"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, n, digest, attempt, at: the newest entry of each part; parts that the input no longer has are gone."""
    where, fs = _files(spark, f"{path}/manifest")
    if not fs.exists(where):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    newest = rows.groupBy("part").agg(F.max_by(F.struct("n", "digest", "attempt", "at"), F.col("at")).alias("e"))
    return newest.select("part", "e.*").filter("attempt is not null")


def digests(numbered: DataFrame, version: str) -> DataFrame:
    """part, n, digest: two sums of row hashes for each part, whatever the order of its rows, and the version of the work."""
    row = F.to_json(F.struct(*[f"`{c}`" for c in numbered.columns if c != "part"]), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")).cast("string")
    found = numbered.groupBy("part").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b"))
    return found.select("part", "n", F.concat_ws(":", F.lit(version), F.lit(_LAYOUT), "n", "a", "b").alias("digest"))


def write_parts_once(
    df: DataFrame, path: str, order: list[str], rows: int, work: Callable[[DataFrame], DataFrame] = lambda d: d, version: str = "1", wave: int | None = None
) -> DataFrame:
    """Parts of `rows` rows in the given order, each put through `work`, as `read_parts` reads them.

    work takes and returns rows with `part` and may not mix parts; say another `version` when it changes.
    `wave` parts are one job; a wave is what a stopped run loses at most. Without it a wave has 64 parts, or
    1/WAVES of all if that is more, so that the number of jobs doesn't grow with the input. The order must tell all rows apart,
    or a part's digest may change between runs (it is then made anew). An empty input has no parts.
    """
    spark = df.sparkSession
    total = df.count()
    wave = wave or max(64, -(-total // (rows * WAVES)))
    numbered = _by_wave(numbered_batches(df, order, rows, total=total).withColumn("_wave", F.floor((F.col("part") - 1) / wave)))
    wanted = settle(digests(numbered.drop("_wave"), version))
    old = settle(manifest(spark, path))
    _drop_unlisted(spark, path, old)
    same = ["part", "n", "digest"]
    missing = _by_wave(wanted.join(old.select(*same), same, "left_anti").withColumn("_wave", F.floor((F.col("part") - 1) / wave)))
    gone = old.join(wanted, "part", "left_anti")
    at = (old.agg(F.max("at")).first()[0] or 0) + 1
    for w in [r["_wave"] for r in missing.select("_wave").distinct().orderBy("_wave").collect()]:  # a number a wave
        attempt, todo = uuid.uuid4().hex, missing.filter(F.col("_wave") == w).drop("_wave")
        chosen = numbered.filter(F.col("_wave") == w).drop("_wave").join(todo.select("part"), "part", "left_semi")
        work(chosen).sortWithinPartitions("part").write.parquet(f"{path}/data/attempt={attempt}")
        _list(todo.withColumn("attempt", F.lit(attempt)), path, at)
    if not gone.isEmpty():
        _list(gone.withColumn("attempt", F.lit(None).cast("string")), path, at)
    return read_parts(spark, path)


def _by_wave(df: DataFrame) -> DataFrame:
    """df, written in a folder for each wave, so that a wave reads no other's rows."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy("_wave").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _list(entries: DataFrame, path: str, at: int) -> None:
    """One file of entries, there in whole or not at all."""
    entries.select("part", "n", "digest", "attempt", F.lit(at).cast("long").alias("at")).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _drop_unlisted(spark: SparkSession, path: str, listed: DataFrame) -> None:
    """Delete the attempts of which the manifest lists no part."""
    where, fs = _files(spark, f"{path}/data")
    if fs.exists(where):
        keep = {f"attempt={r.attempt}" for r in listed.select("attempt").distinct().collect()}  # one a wave
        for found in fs.listStatus(where):
            if found.getPath().getName() not in keep:
                fs.delete(found.getPath(), True)


def read_parts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The rows of all listed parts with `part`; of the first parts only, if `first` says how many: rows of others are passed over by the files' statistics."""
    listed = manifest(spark, path)
    if first is not None:
        listed = listed.orderBy("part").limit(first)
        last = listed.agg(F.max("part")).first()[0] or 0
    attempts = [r.attempt for r in listed.select("attempt").distinct().collect()]  # one a wave
    if not attempts:
        raise FileNotFoundError(f"no finished parts in {path}")
    data = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/attempt={a}" for a in attempts])
    data = data if first is None else data.filter(F.col("part") <= last)
    parts = data.withColumn("part", F.col("part").cast("long")).withColumn("attempt", F.col("attempt").cast("string"))
    return parts.join(F.broadcast(listed.select("part", "attempt")) if first is not None else listed.select("part", "attempt"), ["part", "attempt"], "left_semi").drop("attempt")
