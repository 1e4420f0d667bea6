"""Drivers, partition loads, SQL functions and the array forms that they use."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import arrays, sql, text
from tideline.operators import drivers, labels, steps
from tideline.sources import text as annotations

IV = "array<struct<start: double, end: double>>"


def test_rounding_like_python(spark):
    rng = random.Random(3)
    xs = [2.675, 0.125, 0.375, 2.5, 1.5, -2.5, -0.125, 1.005, 0.0005, 1e9 + 0.0005, 0.0, -1.0005, 0.3, 12345.6785, *[rng.randrange(10**6) * 0.0005 for _ in range(500)], *[rng.uniform(-1e4, 1e4) for _ in range(200)], *[i * 0.6 for i in range(500)]]
    for k in (0, 1, 3):
        got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(text.round_half_even(F.col("x"), k)).collect()]
        assert got == [float(round(x, k)) for x in xs]


def test_array_forms(spark):
    rng = random.Random(5)
    spot = lambda: rng.choice([float(rng.randrange(40)), rng.random() * 40])
    rows = [(i, [tuple(sorted((spot(), spot()))) for _ in range(rng.randrange(0, 12))]) for i in range(150)] + [(999, [(1.0, 1.0)]), (1000, [(3.0, 1.0), (1.0, 2.0)])]
    df = spark.createDataFrame(rows, f"i int, iv {IV}")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", arrays.merge(F.col("iv")).alias("m")).collect()}
    for i, iv in rows:
        held = []
        for s, e in sorted(x for x in iv if x[0] <= x[1]):
            if held and held[-1][1] >= s:
                held[-1] = (held[-1][0], max(e, held[-1][1]))
            else:
                held.append((s, e))
        assert got[i] == held
    named = spark.createDataFrame([([("b", 2.0, 3.0), ("a", 2.0, 3.0), ("z", 5.0, 5.0), ("c", 1.0, 9.0), ("d", 2.0, 4.0), ("e", 1.0, 9.0)],)], "x array<struct<label: string, start: double, end: double>>")
    first, ordered = named.select(arrays.first_of_each(F.col("x")), arrays.sort_by_start(F.col("x"))).first()
    assert [r.label for r in first] == ["b", "c", "d"]
    assert [r.label for r in ordered] == ["c", "e", "b", "a", "d", "z"]
    empty = spark.createDataFrame([([],), (None,)], f"iv {IV}").select(arrays.merge(F.col("iv")), arrays.sort_by_start(F.col("iv"))).collect()
    assert [tuple(r) for r in empty] == [([], []), (None, None)]


def test_merge_of_a_long_list(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda i: F.struct((i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"))).alias("iv"))
    assert df.select(F.size(arrays.merge(F.col("iv")))).first()[0] == 200_001


def test_partition_loads(spark, tmp_path):
    for i, name in enumerate(["train_100_both_part1_2mix", "train_100_both_part2_2mix", "dev_both_part1_2mix", "sparse_2_x"]):
        spark.createDataFrame([(i,)], "i int").coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        part = next((tmp_path / f"t{i}").glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{name}.parquet")
    of = lambda **k: sorted(r.i for r in annotations.parts_of(spark, str(tmp_path / "all"), **k).collect())
    assert of() == [0, 1, 2, 3] and of(contains="sparse_2") == [3] and of(prefix="train_100", suffix="_2mix.parquet") == [0, 1] and of(part=1) == [0, 2] and of(prefix="dev", part=1) == [2]
    assert of(contains="both", part=1) == [0, 2]
    with pytest.raises(ValueError):
        of(contains="a*")


def test_guarded_csv(spark, tmp_path):
    assert annotations.csv_if_sound(spark, str(tmp_path / "none.csv"), "a int, b string").count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert annotations.csv_if_sound(spark, str(tmp_path / "empty.csv"), "a int, b string").count() == 0
    (tmp_path / "bad.csv").write_text("a,b\n1,x\nword,y\n3,z\n")
    rows = annotations.csv_if_sound(spark, str(tmp_path / "bad.csv"), "a int, b string")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "x"), (3, "z")]


def test_sql_functions(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    row = spark.sql(
        "SELECT hash_bucket('abc') h, signal_power(array(1f, 3f)) p, signal_power(array()) q, snr_db(100D, 1D) s, argmax0(array(1D, 5D, 5D)) m, split_mixture('1-2-3_4-5-6', 1) x, "
        "total_length(intersect_intervals(array(named_struct('start', 0D, 'end', 5D)), array(named_struct('start', 3D, 'end', 9D)))) t, size(drop_empty(array(named_struct('start', 1D, 'end', 1D)))) d"
    ).first()
    same = spark.range(1).select(text.hash_bucket(F.lit("abc"))).first()[0]
    assert (row.h, row.p, row.q, row.s, row.m, row.x, row.t, row.d) == (same, 5.0, None, 20.0, 1, "4-5-6", 2.0, 0)


def test_sparse_mixtures_of_three(spark):
    rows = [("m", "s1", 0.0, 4.0), ("m", "s2", 2.0, 6.0), ("m", "s3", 3.0, 3.5), ("m", "noise", 0.0, 8.00049), ("n", "noise", 0.0, 1.0)]
    rec = spark.createDataFrame(rows, "mixture_name string, source string, start double, stop double")
    got = sorted((r.audio_id, r.label, r.start, r.end) for r in labels.sparse_mixture_labels(rec, 3, cell=2.0).collect())
    assert got == sorted(
        [("m", "one_spk", 0.0, 2.0), ("m", "two_spk", 2.0, 3.0), ("m", "three_spk", 3.0, 3.5), ("m", "two_spk", 3.5, 4.0), ("m", "one_spk", 4.0, 6.0), ("m", "non_speech", 6.0, 8.0),
         ("m", "speech_times", 0.0, 6.0), ("m", "two_or_three_spk", 2.0, 4.0), ("n", "non_speech", 0.0, 1.0)]
    )


def test_driver_edges(spark):
    samples = spark.createDataFrame([("a", [1.0] * 10), ("b", []), ("c", None)], "audio_id string, amp array<float>")
    labels_ = spark.createDataFrame([("a", "one_spk", 2, 0.0, 4.0)], "audio_id string, label string, priority int, start double, end double")
    rec = spark.createDataFrame([("a", 4.5), ("b", 3.0), ("c", 3.0), ("d", 3.0)], "audio_id string, duration double")
    rows = {r.audio_id: r for r in drivers.annotate_chunks(samples, labels_, rec, 1.0, 3).collect()}
    assert [len(x) for x in rows["a"].amp_chunks] == [3, 3, 3] and rows["a"].chunks_class == [["one_spk"]] * 3 and rows["a"].chunk_filenames == ["a_0.0_1.0", "a_1.0_2.0", "a_2.0_3.0"]
    assert rows["b"].amp_chunks == [] and "d" not in rows
    with pytest.raises(ValueError):
        drivers.annotate_chunks(samples, labels_, rec, 1.0, 3, "other")
    with pytest.raises(ValueError):
        drivers.segment_signals(samples, labels_, 4, 3)
    with pytest.raises(ValueError):
        drivers.curate(samples, "augment_train")
    three = spark.createDataFrame([("a", *[[(0.0, 1.0)]] * 5)], f"audio_id string, non_speech {IV}, one_spk {IV}, two_spk {IV}, two_or_three_spk {IV}, three_spk {IV}")
    out = drivers.segment_signals(samples, three, 3, 3)
    assert out.columns == ["audio_id", *[f"{c}_signal" for c in drivers.SEGMENTS[3]]] and len(out.first().three_spk_signal[0]) == 3
    train = drivers.curate(out, "train", encoded=True, rate=2)
    assert sorted(r.label for r in train.collect()) == [0, 1, 2] and all(len(r.input_values) == 2 for r in train.collect())


def test_steps_end_lineage_and_go(spark):
    held = steps.Steps(spark)
    a = held.settle(spark.range(5))
    b = held.settle(a.selectExpr("id + 1 as id"))
    held.done(b)
    assert b.count() == 5 and len(held.paths) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        a.count()
