"""Counts of each stage of a run, taken while the stage is written, and their table.

The counts are observed at the top of the writing job: no second pass reads the stage, and as a write's
last tasks count once each, lost executors and retries don't count rows twice. What comes to the
driver is one number for each count. An empty stage has zeros.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tideline.operators.steps import settle

_SCHEMA = "run string, position int, stage string, kind string, name string, n long"


class Run:
    """Stages of one run, in the order in which they are written."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.name = spark, name or uuid.uuid4().hex
        self._rows: list[tuple] = []
        self._stages = 0

    def stage(self, name: str, df: DataFrame, errors: dict[str, Column] | None = None, path: str | None = None) -> DataFrame:
        """df, written (to the shared folder or `path`) and read again, with its rows, nulls by column and errors counted.

        errors: what holds for a faulty row, by name; a null doesn't count. Rows stay, faulty or not.
        """
        counts = [("rows", None, F.count(F.lit(1)))]
        counts += [("nulls", f.name, F.count_if(F.col(_quoted(f.name)).isNull())) for f in df.schema]
        counts += [("errors", e, F.count_if(c)) for e, c in (errors or {}).items()]
        seen = Observation(uuid.uuid4().hex)
        out = settle(df.observe(seen, *[c.alias(f"n{i}") for i, (_, _, c) in enumerate(counts)]), path)
        found = seen.get
        self._stages += 1
        self._rows += [(self.name, self._stages, name, kind, of, found.get(f"n{i}") or 0) for i, (kind, of, _) in enumerate(counts)]
        return out

    def table(self) -> DataFrame:
        """run, position, stage, kind (rows, nulls, errors), name (of the column or error, else null), n."""
        return self.spark.createDataFrame(self._rows, _SCHEMA)

    def save(self, path: str) -> None:
        """Add the run's table to those at `path`."""
        self.table().coalesce(1).write.mode("append").parquet(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
