"""Array, name and relational functions, metrics, sources, sinks, streaming."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import arrays, text
from tideline.operators import curation, metrics, relational
from tideline.sources import sinks, wav
from tideline.sources import text as annotations
from tideline.streaming import windows


def test_arrays(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 8)], [9.0, 9.0], [], ["", "a", ""])], "a array<float>, b array<double>, e array<float>, w array<string>")
    a, e = F.col("a"), F.col("e")
    r = df.select(
        arrays.full_chunks(a, 3).alias("full"), arrays.tail_chunks(a, 3).alias("tail"), arrays.fixed_chunks(a, 3, F.lit(4)).alias("fixed"), arrays.full_chunks(e, 3).alias("none"), arrays.slice0(a, F.lit(-2), F.lit(99)).alias("s"),
        arrays.pad_truncate(a, 3).alias("cut"), arrays.pad_truncate(a, 9).alias("pad"), arrays.power(e).alias("p0"), arrays.power(F.col("b")).alias("p"), arrays.snr(F.lit(10.0), F.lit(1.0)).alias("snr"), arrays.snr(F.lit(1.0), F.lit(0.0)).alias("inf"),
        arrays.argmax(a).alias("m"), arrays.argmax(e).alias("m0"), arrays.positions_of(F.col("w"), F.lit("")).alias("at"), arrays.gather(a, F.array(F.lit(0), F.lit(2)), 1).alias("g"), arrays.drop_last(e).alias("d"), arrays.period_of(F.col("b")).alias("per"), arrays.period_of(e).alias("per0"),
    ).first()
    assert (r.full, r.tail[-1], len(r.fixed), r.fixed[3], r.none) == ([[1, 2, 3], [4, 5, 6]], [7], 4, [], [])
    assert (len(r.s), r.cut, r.pad[-2:], r.p0, r.p, r.snr, r.inf) == (7, [1, 2, 3], [0, 0], None, 81, 10, None)
    assert (r.m, r.m0, r.at, r.g, r.d, r.per, r.per0) == (6, None, [0, 2], [2, 4], [], 0, None)


def test_first_of_each(spark):
    df = spark.sql("select array(named_struct('label','x','start',0,'end',1), named_struct('label','y','start',0,'end',1), named_struct('label','z','start',2,'end',2)) as a")
    assert [x["label"] for x in df.select(arrays.first_of_each(F.col("a")).alias("a")).first().a] == ["x"]


def test_names(spark):
    df = spark.createDataFrame([("103-1240-0003_1235-5-7", "a", 2, "x/y/Name.WAV", "FM")], "m string, id string, i int, p string, g string")
    r = df.select(
        text.split_mixture(F.col("m"), 0).alias("m0"), text.split_mixture(F.col("m"), 1).alias("m1"), text.split_mixture(F.col("m"), 2).alias("m2"), text.chunk_name(F.col("id"), F.col("i"), 0.6).alias("n"), text.chunk_name(F.col("id"), F.col("i"), 0.6, None).alias("plain"),
        text.last_part(F.col("p"), stem=True).alias("stem"), text.lower_suffix(F.col("p")).alias("low"), text.recode(F.col("g"), text.SEX_PAIR).alias("sex"), text.recode(F.lit("QQ"), text.SEX_PAIR).alias("same"),
        wav.sparse_path(F.lit("f_1/b"), "wav16k", "s", True).alias("dashed"), wav.wav_path("dev", "wav8k", "mix_both", F.col("id")).alias("path"),
    ).first()
    assert (r.m0, r.m1, r.m2, r.n, r.plain) == ("103-1240-0003", "1235-5-7", None, "a_1.2_1.8", "a_1.2_1.7999999999999998")
    assert (r.stem, r.low, r.sex, r.same, r.dashed, r.path) == ("Name", "x/y/Name.wav", "1M1F", "QQ", "f-1/wav16k/s/f-1-b.wav", "wav8k/max/dev/mix_both/a.wav")
    assert text.label_file_name("train-100", "both", "part1") == "train_100_both_part1_2mix_osd_labels.parquet.gzip"
    with pytest.raises(ValueError):
        text.sampling_rate("wav44k")


MATRICES = [  # fixed values: published matrices with accuracy, macro F1 and weighted F1
    ([[2185, 3625, 519], [75, 35736, 2426], [1, 1062, 39078]], (0.91, 0.79, 0.90)),
    ([[3719, 3741, 422], [115, 53902, 8304], [1, 2957, 92390]], (0.91, 0.82, 0.90)),
    ([[11189, 2940, 234], [2022, 134769, 7265], [350, 13751, 25627]], (0.87, 0.81, 0.86)),
    ([[24490, 5106, 247], [5503, 209612, 9109], [817, 19465, 22812]], (0.86, 0.78, 0.86)),
    ([[13857, 449, 57], [14773, 126809, 2474], [4565, 24421, 10742]], (0.76, 0.62, 0.75)),
    ([[11424, 2663, 276], [2082, 134149, 7825], [382, 13285, 26061]], (0.87, 0.81, 0.86)),
    ([[2801, 4446, 635], [81, 52131, 10109], [1, 1686, 93661]], (0.90, 0.77, 0.89)),
    ([[1383, 4251, 695], [42, 35088, 3107], [0, 620, 39521]], (0.90, 0.73, 0.88)),
    ([[248, 4336, 1745], [1, 32443, 5793], [0, 398, 39743]], (0.86, 0.62, 0.82)),
]


@pytest.mark.parametrize("matrix, want", MATRICES)
def test_published_reports(spark, matrix, want):
    df = spark.createDataFrame([(t, p, n) for t, row in enumerate(matrix) for p, n in enumerate(row)], "truth int, predicted int, n long")
    got = {r["name"]: r.f1 for r in metrics.classification_report(df).collect()}
    assert tuple(round(got[k], 2) for k in ("accuracy", "macro avg", "weighted avg")) == want


def test_relational(spark, tmp_path):
    left = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "a int, b int")
    bad = spark.createDataFrame([(3,), (3,)], "id int")
    assert sorted(r.a for r in relational.without_each(left, bad, "id", ["a", "b"]).collect()) == [1, 9]
    look = relational.first_match(left, spark.createDataFrame([(1, 7, "x"), (1, 5, "y")], "a int, o int, v string"), "a", ["o"], ["v"])
    assert {r.a: r.v for r in look.collect()} == {1: "y", 2: None, 9: None}
    numbers = spark.range(5).selectExpr("id", "id * 2 as other")
    assert [r.part for r in relational.numbered_batches(numbers, ["id"], 2).orderBy("id").collect()] == [1, 1, 2, 2, 3]
    assert relational.numbered_batches(numbers.limit(0), ["id"], 2).count() == 0
    sinks.write_parts(numbers.filter("id < 4"), str(tmp_path / "p"), ["id"], 2)
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=1", "part=2"]
    flags = relational.quality_flags(spark.createDataFrame([("WAV", 16000, 1, 2.0), ("FLAC", 8000, 2, -1.0), (None, None, None, None)], "file_type string, sampling_rate int, channels int, duration double"), 16000, 10)
    assert tuple(relational.quality_report(flags).first()) == (3, 2, 2, 2, 2, 2)
    assert {r.bin: r.n for r in relational.histogram(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), "x").collect()} == {0: 2}


def test_annotation_text(spark, tmp_path):
    line = '103-1240-0000 ",HELLO,WORLD,,AGAIN," "0.50,0.90,1.40,1.90,2.30,2.80"'
    df = annotations.speech_ranges(annotations.alignments(spark.createDataFrame([(line,), ('x ",A," "1.0,2.0,3.0"',)], "value string")))
    rows = {r.unique_id: r for r in df.collect()}
    r = rows["103-1240-0000"]
    assert r.words == ["HELLO", "WORLD", "", "AGAIN"] and (r.pause_start_time, r.pause_stop_time) == ([1.40], [1.90])
    assert list(zip(r.start_time, r.stop_time, strict=True)) == [(0.50, 1.40), (1.90, 2.30)]
    assert (rows["x"].start_time, rows["x"].stop_time) == ([1.0], [2.0])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        annotations.alignments(spark.createDataFrame([('x ",A," "1.0,oops"',)], "value string")).collect()
    ids = annotations.ids_in(spark.createDataFrame([("103-1240-0000 and 1235-135887-0017, not 12-1-1",)], "t string"), "t")
    assert [x.timing for x in ids.collect()] == ["103-1240-0000", "1235-135887-0017"]
    (tmp_path / "a.rttm").write_text("SPEAKER rec1 1 9.0 1.0 <NA> <NA> old <NA> <NA>\nSPEAKER rec2 1 0.0 1.0 <NA> <NA> x <NA> <NA>\n")
    (tmp_path / "b.rttm").write_text("SPEAKER rec1 1 0.50 1.00 <NA> <NA> spkA <NA> <NA>\nSPEAKER  rec1 1 1.20 0.50 <NA> <NA> spkB <NA> <NA>\n\n")
    rttm = sorted(tuple(x) for x in annotations.rttm_files(spark, str(tmp_path), speaker=True).collect())
    assert rttm == [("rec1", 0.5, 1.5, "spkA"), ("rec1", 1.2, 1.7, "spkB"), ("rec2", 0.0, 1.0, "x")]
    (tmp_path / "m.json").write_text('[{"mixture_name": "m", "s1": [{"start": 0.0, "stop": 1.0}], "s2": [], "s3": [{"start": 2.0, "stop": 3.0, "sub_utt_num": 4}]}]')
    got = {(x.source, x.start, x.sub_utt_num) for x in annotations.mixture_json(spark, str(tmp_path / "m.json"), ["s1", "s3"]).collect()}
    assert got == {("s1", 0.0, None), ("s3", 2.0, 4)}
    (tmp_path / "x_info.csv").write_text("mixture_ID,speaker_1_sex\na,F\n")
    (tmp_path / "._x_info.csv").write_text("mixture_ID,speaker_1_sex\nb,M\n")
    assert [x.mixture_ID for x in annotations.info_csv(spark, str(tmp_path)).collect()] == ["a"]


def test_wav(spark, tmp_path):
    def write(name, rate, channels, samples):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(struct.pack(f"<{len(samples)}h", *samples))

    write("mono.wav", 16000, 1, [0, 16384, -32768])
    write("stereo.wav", 8000, 2, [100, 300] * 8000)
    write("empty.wav", 16000, 1, [])
    (tmp_path / "broken.wav").write_bytes(b"no wave")
    rows = {r.file_name: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    assert rows["mono"].amp == [0.0, 0.5, -1.0] and rows["stereo"].channels == 2 and rows["stereo"].duration == 1.0
    assert rows["empty"].duration == 0 and rows["broken"].file_type is None
    flags = relational.quality_flags(wav.read_wav(spark, str(tmp_path), samples=False), 16000, 10)
    assert {r.file_name for r in flags.filter("bad").collect()} == {"stereo", "empty", "broken"}
    wanted = spark.createDataFrame([("mono",), ("gone",)], "audio_id string")
    assert [r.audio_id for r in wav.missing_files(wanted, "audio_id", wav.read_wav(spark, str(tmp_path), False)).collect()] == ["gone"]


def test_curation_and_sinks(spark, tmp_path):
    df = spark.sql("select array(0.1f,0.2f,0.3f,0.4f) as amp, array(named_struct('start',0.0D,'end',0.5D)) as r, array(array(1.0f)) as none").withColumn("e", F.slice("r", 1, 0))
    seg = df.select(curation.segments_of(F.col("amp"), F.col("r"), 4).alias("one_spk_signal"), curation.segments_of(F.col("amp"), F.col("e"), 4).alias("non_speech_signal"), F.col("none").alias("two_spk_signal"))
    assert sorted((r.label, len(r.input_values)) for r in curation.training_rows(seg).collect()) == [(0, 0), (1, 2), (2, 1)]
    assert curation.training_rows(seg, least=1).count() == 1
    padded = curation.encode(spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "input_values array<float>"), 2, 1, pad=True)
    assert sorted(r.input_values for r in padded.collect()) == [[1, 0], [1, 2]]
    scored = curation.predict(spark.createDataFrame([("a", 1, [1.0, 5.0]), ("b", 0, [1.0])], "id string, label int, input_values array<float>"), lambda x: np.array([[s[0], s[1]] for s in x]), ["id"], least=1)
    assert [tuple(r) for r in scored.collect()] == [("a", 1, 1)]
    sinks.write_csv(df.select("r"), str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True).select(annotations.as_list(F.col("r"), "array<struct<start: double, end: double>>").alias("r"))
    assert back.first().r[0]["end"] == 0.5
    sinks.write_report(df.selectExpr("1 as n"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"n":1}'


def test_streams(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:01' as ts, 1 as k union all select timestamp'2024-01-01 00:00:02', 1 union all select timestamp'2024-01-01 00:01:00', 1").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, k int").parquet(str(tmp_path / "in"))
    for name, df, want in (("tumble", windows.chunk_counts(events, "ts", ["k"], "10 seconds", "1 minute"), [1, 2]), ("sess", windows.sessions(events, "ts", ["k"], "5 seconds", "1 minute"), [1, 2])):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.n for r in spark.table(name).collect()) == want
