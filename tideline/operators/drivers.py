"""Whole data sets from their parts: annotated chunks, segments by class, curated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays, text
from tideline.operators import chunks, curation

#: Class columns that get a signal of their own; ranges of single sources are left out, as no later step uses them.
SEGMENTS = {2: ("non_speech", "one_spk", "two_spk"), 3: ("non_speech", "one_spk", "two_spk", "two_or_three_spk", "three_spk")}


def in_split(df: DataFrame, splits: DataFrame, split: str, key: str = "audio_id") -> DataFrame:
    """Rows of df whose key the splits (key, split) put into `split`."""
    return df.join(splits.filter(F.col("split") == split).select(key), key, "left_semi")


def annotate_chunks(samples: DataFrame, labels: DataFrame, recordings: DataFrame, seconds: float, rate: int, rule: str = "majority", splits: DataFrame | None = None) -> DataFrame:
    """audio_id, amp_chunks, chunks_class, chunk_filenames: a recording a row, three arrays of equal length.

    samples: audio_id, amp. labels: audio_id, label, priority, start, end in seconds. recordings: audio_id, duration.
    rule "majority" leaves out the last chunk and keeps all tied classes; "sparse" keeps floor(duration / seconds)
    chunks and one class each. Chunks without signal are left out. With splits, only evaluation recordings stay.
    Classes meet signals once, by recording; a recording without samples has no row.
    """
    if rule not in ("majority", "sparse"):
        raise ValueError(f"no such rule: {rule!r}")
    if splits is not None:
        recordings = in_split(recordings, splits, "evaluation")
    key, sparse = ["audio_id"], rule == "sparse"
    grid = chunks.grid(recordings, key, "duration", seconds, "full" if sparse else "drop")
    own = labels.join(recordings.select("audio_id"), "audio_id", "left_semi")
    if sparse:
        found = chunks.sparse_rule(own, grid, key, seconds, decimals=1).select(*key, "chunk", F.array("label").alias("tied"))
    else:
        found = chunks.tied_labels(own, grid, key, seconds)
    classes = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "tied"))).alias("_c"))
    cut = arrays.full_chunks(F.col("amp"), int(seconds * rate))
    both = samples.select("audio_id", cut.alias("_a")).join(classes, "audio_id")
    n = F.least(F.size("_a"), F.size("_c"))
    name = text.sparse_chunk_name if sparse else text.chunk_name
    return both.select(
        "audio_id", F.slice("_a", 1, n).alias("amp_chunks"), F.transform(F.slice("_c", 1, n), lambda x: x["tied"]).alias("chunks_class"),
        F.transform(F.slice("_c", 1, n), lambda x: name(F.col("audio_id"), x["chunk"], seconds)).alias("chunk_filenames"),
    )


def segment_signals(samples: DataFrame, ranges: DataFrame, sources: int, rate: int, splits: DataFrame | None = None) -> DataFrame:
    """audio_id and the sample slices of each class: `{class}_signal`; of training recordings only, if splits are given.

    samples: audio_id, amp. ranges: audio_id and an array of intervals for each class; overlaps may stand for two_spk.
    Zero-length intervals go first; a class without intervals is one empty slice.
    """
    if sources not in SEGMENTS:
        raise ValueError("sources must be 2 or 3")
    rows = ranges.withColumnRenamed("overlaps", "two_spk") if "two_spk" not in ranges.columns else ranges
    rows = rows if splits is None else in_split(rows, splits, "training")
    signal = lambda c: curation.segments_of(F.col("amp"), arrays.drop_empty(F.col(c)), rate).alias(f"{c}_signal")
    return samples.select("audio_id", "amp").join(rows, "audio_id").select("audio_id", *[signal(c) for c in SEGMENTS[sources]])


def curate(df: DataFrame, kind: str, encoded: bool = False, rate: int = 16000, seconds: float = 1.0, pad: bool = False, part: Column | None = None) -> DataFrame:
    """Rows for training or scoring by the kind of data set.

    train: label, input_values from class signals; evaluation, test, sparse_test: audio_id, label, input_values,
    chunk_filenames from annotated chunks. `part` filters the input's partitions; encoded cuts (or pads) signals.
    """
    if part is not None:
        df = df.filter(part)
    if kind == "train":
        columns = {c: f"{c}_signal" for c in text.CLASS_CODE if f"{c}_signal" in df.columns}
        rows = curation.training_rows(df, columns)
    elif kind in ("evaluation", "test", "sparse_test"):
        rows = curation.evaluation_rows(df)
    else:
        raise ValueError(f"no such kind of data set: {kind!r}")
    return curation.encode(rows, seconds, rate, pad) if encoded else rows
