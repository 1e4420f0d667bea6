"""From labelled recordings to training and evaluation rows, and batched scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays
from tideline.functions.text import CLASS_CODE, recode


def segments_of(amp: Column, ranges: Column, rate: int) -> Column:
    """The sample slices of time ranges in seconds; a list with one empty slice if there are no ranges."""
    cut = F.transform(ranges, lambda r: arrays.slice0(amp, (r["start"] * rate).cast("int"), (r["end"] * rate).cast("int")))
    return F.when(F.size(ranges) > 0, cut).otherwise(F.array(F.slice(amp, 1, 0)))


def training_rows(df: DataFrame, columns: dict[str, str] | None = None, least: int = 0) -> DataFrame:
    """label, input_values: a row for each segment of each class column; those of `least` values or fewer go."""
    columns = columns or {c: f"{c}_signal" for c in CLASS_CODE}
    each = F.explode(F.array(*[F.struct(F.lit(CLASS_CODE[c]).alias("label"), F.col(name).alias("segments")) for c, name in columns.items()])).alias("x")
    rows = df.select(each).select("x.label", F.explode("x.segments").alias("input_values")).filter(F.col("input_values").isNotNull())
    return rows.filter(F.size("input_values") > least) if least else rows


def evaluation_rows(df: DataFrame) -> DataFrame:
    """audio_id, label, input_values, chunk_filenames: chunks, classes and names paired by position; the first class counts."""
    zipped = F.explode(F.arrays_zip("amp_chunks", "chunks_class", "chunk_filenames")).alias("z")
    rows = df.select("audio_id", zipped)
    return rows.select("audio_id", recode(F.get("z.chunks_class", 0), CLASS_CODE).cast("int").alias("label"), F.col("z.amp_chunks").alias("input_values"), F.col("z.chunk_filenames").alias("chunk_filenames"))


def encode(df: DataFrame, seconds: float = 1.0, rate: int = 16000, pad: bool = False) -> DataFrame:
    """input_values cut to `seconds`, or also filled up with zeros to it."""
    n = int(seconds * rate)
    x = arrays.pad_truncate(F.col("input_values"), n) if pad else F.slice("input_values", 1, n)
    return df.withColumn("input_values", x)


def predict(df: DataFrame, scorer: Callable[[list[np.ndarray]], np.ndarray], keys: list[str], least: int = 400, batch: int = 2048) -> DataFrame:
    """keys, label, predicted_label: scorer gives the logits of a batch of signals; signals of `least` values or fewer go."""
    rows = df.filter(F.size("input_values") > least).select(*keys, "label", "input_values")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                signals = [np.asarray(x.values) for x in part.column(part.num_columns - 1)]
                found = np.asarray(scorer(signals)).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[*keys, "label", "predicted_label"])

    schema = rows.select(*keys, "label", F.lit(0).alias("predicted_label")).schema
    return rows.mapInArrow(score, schema)
