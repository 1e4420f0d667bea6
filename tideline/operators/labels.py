"""End-to-end labels of mixtures: metadata and alignments in, labelled intervals out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays, text
from tideline.operators import intervals, relational

LABELS = {2: ("non_speech", "one_spk", "two_spk"), 3: ("non_speech", "one_spk", "two_spk", "three_spk", "two_or_three_spk")}


def enrich(mixtures: DataFrame, unaligned: DataFrame, sources: int, rate: int = 16000) -> DataFrame:
    """audio_id, duration, source_1, ...: mixtures (mixture_ID, length in samples) none of whose sources is in unaligned (timing)."""
    ids = [f"source_{i + 1}" for i in range(sources)]
    rows = mixtures.select(F.col("mixture_ID").alias("audio_id"), (F.col("length") / F.lit(rate)).alias("duration"), *[text.split_mixture(F.col("mixture_ID"), i).alias(s) for i, s in enumerate(ids)])
    return relational.without_each(rows, unaligned, "timing", ids)


def speech(enriched: DataFrame, ranges: DataFrame) -> DataFrame:
    """audio_id, source, start, end inside [0, duration]: the speech of each source by the first of its alignment rows.

    A source without an alignment has no rows: it counts as silent.
    """
    sources = [c for c in enriched.columns if c.startswith("source_")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("unique_id")) for c in sources])).alias("s")
    rows = enriched.select("audio_id", "duration", each).select("audio_id", "duration", "s.*")
    first = ranges.groupBy("unique_id").agg(F.min(F.struct("start_time", "stop_time")).alias("r"))
    iv = F.explode(arrays.zip_intervals(F.col("r.start_time"), F.col("r.stop_time"))).alias("iv")
    found = rows.join(first, "unique_id").select("audio_id", "duration", "source", iv)
    clipped = found.select("audio_id", "source", F.greatest("iv.start", F.lit(0.0)).alias("start"), F.least("iv.end", "duration").alias("end"))
    return intervals.well_formed(clipped)


def mixture_labels(enriched: DataFrame, ranges: DataFrame, cell: float | None = None) -> DataFrame:
    """audio_id, label, start, end for mixtures of two or three sources; the classes tile [0, duration]."""
    sources = sum(c.startswith("source_") for c in enriched.columns)
    spans = enriched.filter("duration > 0").select("audio_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return intervals.speaker_labels(speech(enriched, ranges), spans, ["audio_id"], "source", sources, cell)


def sparse_mixture_labels(records: DataFrame, sources: int, folder: Column | None = None, cell: float | None = None) -> DataFrame:
    """audio_id, label, start, end from records (mixture_name, source, start, stop) of sparse mixtures.

    The noise record is the span, rounded to three decimals; the other sources (s1, s2, s3) are speech.
    The label speech_times is the union of all speech inside the span. `folder` goes before the name in audio_id.
    """
    name = F.col("mixture_name") if folder is None else F.concat(folder, "mixture_name")
    rows = records.select(name.alias("audio_id"), "source", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("end"))
    spans = rows.filter("source = 'noise'").select("audio_id", text.round_half_even(F.col("start"), 3).alias("start"), text.round_half_even(F.col("end"), 3).alias("end"))
    iv = rows.filter(F.col("source").isin([f"s{i + 1}" for i in range(sources)]))
    names = LABELS[sources]

    def of(depth: Column) -> Column:
        name = F.get(F.array(*map(F.lit, names[: sources + 1])), F.least(depth, F.lit(sources)).cast("int"))
        spoken = F.when(depth > 0, F.array(name, F.lit("speech_times"))).otherwise(F.array(name))
        return F.when(depth > 1, F.array(name, F.lit("speech_times"), F.lit("two_or_three_spk"))).otherwise(spoken) if sources > 2 else spoken

    return intervals.labelled_segments(iv, ["audio_id"], of, spans, cell, "source")


def label_arrays(labels: DataFrame, sources: int) -> DataFrame:
    """One row for each audio_id with a sorted array of intervals for each label."""
    held = lambda name: F.array_sort(F.collect_list(F.when(F.col("label") == name, F.struct("start", "end")))).alias(name)
    return labels.groupBy("audio_id").agg(*[held(x) for x in LABELS[sources]])


def recording_features(df: DataFrame, amp: Column, rate: int, segments) -> DataFrame:
    """df with power by class, signal-to-noise ratios against non-speech, and seconds by class.

    `segments(amp, ranges, rate)` cuts the samples; the samples themselves go no further.
    """
    names = LABELS[2]
    powers = {f"{n}_signal": arrays.power(F.flatten(segments(amp, F.col(n), rate))) for n in names}
    noise = F.col("non_speech_signal")
    rows = df.withColumns(powers | {f"{n}_period": arrays.total_length(F.col(n)) for n in names})
    return rows.withColumns({"one_spk_SNR": arrays.snr(F.col("one_spk_signal"), noise), "two_spk_SNR": arrays.snr(F.col("two_spk_signal"), noise)})


def with_pair(df: DataFrame, info: DataFrame) -> DataFrame:
    """df joined with the speakers' info (mixture_ID, speaker_1_sex, speaker_2_sex, ...) and `gender_combi`; repeated info rows repeat rows."""
    pair = text.recode(F.concat("speaker_1_sex", "speaker_2_sex"), text.SEX_PAIR)
    return df.join(info, df.audio_id == info.mixture_ID, "inner").withColumn("gender_combi", pair)


def require_success(training_successful: bool) -> None:
    if not training_successful:
        raise ValueError("the model has not been trained successfully")
