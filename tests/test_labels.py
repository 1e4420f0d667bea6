"""From mixtures and alignments to labels and features."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import curation, labels
from tideline.sources import text as annotations

LINES = [
    ('103-1240-0000 ",A,B,,C," "0.5,0.9,1.4,1.9,2.3,2.8"',),  # speech 0.5-1.4, 1.9-2.3
    ('103-1240-0000 ",A," "0.0,9.0,9.5"',),  # a second row of the id
    ('1235-135887-0017 ",D," "1.0,2.0,2.5"',),  # speech 1.0-2.0
    ('84-121123-0001 ",E," "1.9,9.0,9.5"',),  # to be clipped
]


def test_mixtures(spark):
    ranges = annotations.speech_ranges(annotations.alignments(spark.createDataFrame(LINES, "value string")))
    ranges = ranges.filter("size(words) <> 1 or unique_id not like '103-%'")
    mix = spark.createDataFrame([("103-1240-0000_1235-135887-0017", 48000), ("103-1240-0000_1-1-1", 48000), ("7-7-7_103-1240-0000", 48000)], "mixture_ID string, length long")
    two = labels.enrich(mix, spark.createDataFrame([("7-7-7",)], "timing string"), 2)
    assert sorted(r.audio_id for r in two.collect()) == ["103-1240-0000_1-1-1", "103-1240-0000_1235-135887-0017"]
    for cell in (None, 1.0):
        rows = labels.mixture_labels(two, ranges, cell).filter("audio_id like '%0017'").orderBy("start").collect()
        assert [(r.label, r.start, r.end) for r in rows] == [
            ("non_speech", 0.0, 0.5), ("one_spk", 0.5, 1.0), ("two_spk", 1.0, 1.4), ("one_spk", 1.4, 1.9), ("two_spk", 1.9, 2.0), ("one_spk", 2.0, 2.3), ("non_speech", 2.3, 3.0),
        ]
    silent = labels.mixture_labels(two, ranges).filter("audio_id like '%1-1-1'")
    assert {r.label for r in silent.collect()} == {"non_speech", "one_spk"}
    mix3 = spark.createDataFrame([("103-1240-0000_1235-135887-0017_84-121123-0001", 48000)], "mixture_ID string, length long")
    three = labels.enrich(mix3, spark.createDataFrame([], "timing string"), 3)
    held = labels.label_arrays(labels.mixture_labels(three, ranges), 3).first()
    assert [tuple(x) for x in held.three_spk] == [(1.9, 2.0)]
    assert [tuple(x) for x in held.two_or_three_spk] == [(1.0, 1.4), (1.9, 2.3)]
    total = sum(x["end"] - x["start"] for n in ("non_speech", "one_spk", "two_spk", "three_spk") for x in held[n])
    assert abs(total - 3.0) < 1e-9


def test_features_and_pairs(spark):
    df = spark.sql("select 'm' as audio_id, array(1f, 1f, 10f, 10f) as amp, array(named_struct('start', 0D, 'end', 2D)) as non_speech, array(named_struct('start', 2D, 'end', 4D)) as one_spk")
    df = df.withColumn("two_spk", F.slice("one_spk", 1, 0))
    out = labels.recording_features(df, F.col("amp"), 1, curation.segments_of)
    info = spark.createDataFrame([("m", "F", "M"), ("m", "F", "F"), ("n", "M", "M")], "mixture_ID string, speaker_1_sex string, speaker_2_sex string")
    rows = labels.with_pair(out, info).collect()
    assert sorted(r.gender_combi for r in rows) == ["1M1F", "FF"]
    r = rows[0]
    assert (r.non_speech_signal, r.one_spk_signal, r.two_spk_signal, r.one_spk_SNR, r.two_spk_SNR, r.non_speech_period, r.two_spk_period) == (1, 100, None, 20, None, 2, 0)
    labels.require_success(True)
    with pytest.raises(ValueError):
        labels.require_success(False)
