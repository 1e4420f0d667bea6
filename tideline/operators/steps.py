"""Steps of a computation that are written down: their lineage ends there, and they are read as often as needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) may go without that setting; it then gets a
    temporary folder. On a cluster a missing setting is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local-test")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-tideline-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Settled steps that the steps after them replace: `done` deletes all but those given.

    Call it only once everything that reads the others has itself been settled.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = settle(df, path)
        self.paths[path] = out
        return out

    def done(self, *keep: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [p for p, df in self.paths.items() if not any(df is k for k in keep)]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            del self.paths[path]
