"""Interval algebra: worked examples, properties against a plain sweep, malformed input."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import arrays
from tideline.operators import chunks, intervals

IV = "array<struct<start: double, end: double>>"


def one(spark, **lists):
    return spark.createDataFrame([tuple([tuple(map(float, x)) for x in v] for v in lists.values())], ", ".join(f"{k} {IV}" for k in lists))


def pairs(rows):
    return [[r["start"], r["end"]] for r in rows]


A, B, C = [[3, 5], [9, 10], [11, 25]], [[2, 4], [7, 19], [21, 30]], [[3, 5], [6, 8], [9, 11]]


def test_array_examples(spark):
    df = one(spark, a=A, b=B, c=[[3, 4], [7, 19], [21, 30]], d=C, m=[[1, 3], [2, 4], [5, 7]], t=[[0, 1], [1, 2]], h=[[3, 5], [7, 11]], none=[], full=[[0, 10]], bad=[[3, 6], [1, 4], [-5, 0.5], [9, 20]], z=[[1, 1], [1, 2]])
    col = F.col
    r = df.select(
        arrays.intersect(col("a"), col("b")).alias("i"), arrays.intersect_all(col("a"), col("c"), col("d")).alias("i3"), arrays.merge(col("m")).alias("m"), arrays.merge(col("t")).alias("t"),
        arrays.complement(col("h"), F.lit(0.0), F.lit(30.0)).alias("h"), arrays.complement(col("none"), F.lit(0.0), F.lit(10.0)).alias("none"), arrays.complement(col("full"), F.lit(0.0), F.lit(10.0)).alias("full"),
        arrays.complement(col("bad"), F.lit(0.0), F.lit(10.0)).alias("bad"), arrays.drop_empty(col("z")).alias("z"), arrays.total_length(col("h")).alias("len"),
        arrays.intersect(F.slice("t", 1, 1), F.slice("t", 2, 1)).alias("touch"),
    ).first()
    assert pairs(r.i) == [[3, 4], [9, 10], [11, 19], [21, 25]]
    assert pairs(r.i3) == [[3, 4], [9, 10]]
    assert pairs(r.m) == [[1, 4], [5, 7]] and pairs(r.t) == [[0, 2]]
    assert pairs(r.h) == [[0, 3], [5, 7], [11, 30]] and pairs(r.none) == [[0, 10]] and r.full == []
    assert pairs(r.bad) == [[0.5, 1], [6, 9]]
    assert pairs(r.z) == [[1, 2]] and r.len == 6 and r.touch == []


def random_rows(seed, n_keys=12, sources=3, top=200):
    rng = random.Random(seed)
    return [(k, f"s{s}", *sorted((rng.randrange(top), rng.randrange(top)))) for k in range(n_keys) for s in range(sources) for _ in range(rng.randrange(0, 7))]


@pytest.mark.parametrize("cell", [None, 7, 50])
def test_sweep_against_ticks(spark, cell):
    rows = random_rows(3)
    iv = spark.createDataFrame(rows, "k int, source string, start long, end long")
    spans = spark.createDataFrame([(k, 0, 200) for k in range(12)], "k int, start long, end long")
    on = {k: [sum(any(a <= t < b for kk, ss, a, b in rows if kk == k and ss == s) for s in ("s0", "s1", "s2")) for t in range(200)] for k in range(12)}

    def runs(k, cls):
        out, t = [], 0
        while t < 200:
            e = t
            while e < 200 and cls(on[k][e]) == cls(on[k][t]):
                e += 1
            out.append((k, cls(on[k][t]), t, e))
            t = e
        return out

    got = sorted(tuple(r) for r in intervals.active_classes(iv, spans, ["k"], "source", 2, cell).collect())
    assert got == sorted(x for k in range(12) for x in runs(k, lambda d: min(d, 2)))
    solid = sorted(tuple(r) for r in intervals.merge(iv, ["k"], cell).collect())
    assert solid == sorted((k, a, b) for k in range(12) for k_, c, a, b in runs(k, lambda d: d > 0) if c)
    gaps = sorted(tuple(r) for r in intervals.complement(iv, spans, ["k"], cell).collect())
    assert gaps == sorted((k, a, b) for k in range(12) for k_, c, a, b in runs(k, lambda d: d > 0) if not c)
    back = intervals.complement(intervals.complement(iv, spans, ["k"], cell), spans, ["k"], cell)
    assert sorted(tuple(r) for r in back.collect()) == solid
    again = intervals.merge(intervals.merge(iv, ["k"], cell), ["k"], cell)
    assert sorted(tuple(r) for r in again.collect()) == solid
    meet = intervals.intersect(intervals.merge(iv.filter("source = 's0'"), ["k"]), intervals.merge(iv.filter("source = 's1'"), ["k"]), ["k"], cell or 13)
    ticks = sum(r["end"] - r["start"] for r in meet.collect())
    assert ticks == sum(all(any(a <= t < b for kk, ss, a, b in rows if kk == k and ss == s) for s in ("s0", "s1")) for k in range(12) for t in range(200))


def test_malformed_rows(spark):
    iv = spark.createDataFrame([(1, 5, 5), (1, 9, 3), (1, None, 4), (1, 2, None), (1, 1, 2)], "k int, start long, end long")
    assert [tuple(r) for r in intervals.merge(iv, ["k"]).collect()] == [(1, 1, 2)]
    assert intervals.merge(iv.limit(0), ["k"], 10).count() == 0


def test_chunk_rules(spark):
    labels = [("non_speech", 1, 0, 5), ("one_spk", 2, 5, 10), ("two_spk", 3, 10, 19), ("one_spk", 2, 19, 20), ("non_speech", 1, 20, 24)]
    lab = spark.createDataFrame([("a", *x) for x in labels], "k string, label string, priority int, start long, end long")
    rec = spark.createDataFrame([("a", 34), ("b", 0), ("c", None)], "k string, duration long")
    grid = lambda last: chunks.grid(rec, ["k"], "duration", 10, last)
    assert [grid(x).count() for x in ("drop", "full", "keep")] == [3, 3, 4]
    rows = lambda df: [tuple(r) for r in df.orderBy("chunk").collect()]
    assert rows(chunks.majority(lab, grid("keep"), ["k"], 10)) == [("a", 0, "non_speech", 2), ("a", 1, "two_spk", 1), ("a", 2, "non_speech", 1), ("a", 3, None, 0)]
    assert rows(chunks.sparse_rule(lab, grid("keep"), ["k"], 10)) == [("a", 0, "two_spk"), ("a", 1, "two_spk"), ("a", 2, "non_speech"), ("a", 3, "two_spk")]
    seg = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 9, 11)], "k string, start long, end long")
    assert rows(chunks.overlap_count(seg, grid("keep"), ["k"], 10)) == [("a", 0, 2), ("a", 1, 1), ("a", 2, 0), ("a", 3, 0)]
    twice = lab.unionByName(spark.createDataFrame([("a", "other", 9, 0, 5)], lab.schema))
    assert chunks.labels_in_chunks(twice, ["k"], 10).filter("label = 'other'").count() == 0


@pytest.mark.parametrize("cell", [0.1, 0.6, 10])
def test_times_in_seconds(spark, cell):
    """Doubles with ends on cell borders, next to them and elsewhere."""
    rng = random.Random(11)
    spot = lambda: rng.choice([rng.randrange(300) * 0.1, rng.randrange(50) * 0.6, float(rng.randrange(30)), round(rng.random() * 30, 2), rng.random() * 30])
    rows = [(k, f"s{s}", *sorted((spot(), spot()))) for k in range(6) for s in range(2) for _ in range(5)]
    rows += [(9, "s0", 15.0, 20.5), (9, "s1", 20.1, 20.9), (9, "s0", 20.5, 21.0)]
    iv = spark.createDataFrame(rows, "k int, source string, start double, end double")
    a, b = iv.filter("source = 's0'"), iv.filter("source = 's1'")
    want = sorted((k, max(s, u), min(e, v)) for k, x, s, e in rows for j, y, u, v in rows if k == j and x == "s0" and y == "s1" and max(s, u) < min(e, v))
    assert sorted(tuple(r) for r in intervals.intersect(a, b, ["k"], cell).collect()) == want
    solid = {}
    for k, _, s, e in sorted((k, 0, s, e) for k, _, s, e in rows if s < e):
        held = solid.setdefault(k, [])
        if held and held[-1][1] >= s:
            held[-1] = (held[-1][0], max(held[-1][1], e))
        else:
            held.append((s, e))
    assert sorted(tuple(r) for r in intervals.merge(iv, ["k"], cell).collect()) == sorted((k, *x) for k, held in solid.items() for x in held)
    spans = spark.createDataFrame([(k, 1.0, 29.0) for k in (*range(6), 9)], "k int, start double, end double")
    whole = intervals.active_classes(iv, spans, ["k"], "source", 2, cell)
    plain = intervals.active_classes(iv, spans, ["k"], "source", 2)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in plain.collect())
    last = {}
    for k, _, s, e in sorted((r for r in plain.collect()), key=lambda r: (r[0], r[2])):
        assert last.get(k, 1.0) == s
        last[k] = e
    assert set(last.values()) == {29.0}
    size = 0.6
    grid = chunks.grid(spark.createDataFrame([(k, 30.0) for k in (*range(6), 9)], "k int, duration double"), ["k"], "duration", size, "keep")
    counts = {(r.k, r.chunk): r.label for r in chunks.overlap_count(iv, grid, ["k"], size).collect()}
    assert counts == {(k, c): min(2, sum(j == k and s < e and s < (c + 1) * size and e > c * size for j, _, s, e in rows)) for k in (*range(6), 9) for c in range(50)}
    parts = sorted(tuple(r) for r in chunks.overlaps(iv, ["k"], size).collect())
    cut = [(k, c, max(s, c * size), min(e, (c + 1) * size)) for k, _, s, e in rows if s < e for c in range(51) if s < (c + 1) * size and e > c * size]
    assert parts == sorted(cut)


def test_chunk_classes_in_seconds(spark):
    rows = [("a", "non_speech", 0, 0.0, 0.35), ("a", "one_spk", 1, 0.35, 0.9), ("a", "two_spk", 2, 0.9, 1.2), ("a", "one_spk", 1, 1.2, 20.5)]
    lab = spark.createDataFrame(rows, "k string, label string, priority int, start double, end double")
    grid = chunks.grid(spark.createDataFrame([("a", 20.5)], "k string, duration double"), ["k"], "duration", 0.6, "keep")
    got = {r.chunk: r.label for r in chunks.majority(lab, grid, ["k"], 0.6).collect()}
    assert got == {0: "non_speech", 1: "one_spk"} | {c: "one_spk" for c in range(2, 35)}
    sparse = {r.chunk: r.label for r in chunks.sparse_rule(lab, grid, ["k"], 0.6).collect()}
    assert sparse[0] == "non_speech" and sparse[34] == "one_spk"
    pieces = chunks.labels_in_chunks(lab, ["k"], 0.6).filter("chunk in (1, 34)").orderBy("start").collect()
    assert [(r.chunk, r.label) for r in pieces] == [(1, "one_spk"), (1, "two_spk"), (34, "one_spk")] and pieces[-1].end == 20.5


def test_spans_bound_the_labels(spark):
    iv = spark.createDataFrame([(1, "x", 0, 50), (1, None, 2, 4), (1, None, 3, 6), (2, "x", 1, 2)], "k int, source string, start long, end long")
    spans = spark.createDataFrame([(1, 5, 20), (1, 20, 30)], "k int, start long, end long")
    for cell in (None, 4):
        got = sorted(tuple(r) for r in intervals.active_classes(iv, spans, ["k"], "source", 3, cell).collect())
        assert got == [(1, 1, 6, 30), (1, 2, 5, 6)]


@pytest.mark.parametrize("cell", [None, 40])
def test_tasks_follow_the_points(spark, monkeypatch, cell):
    rows = [(k, s, t, t + 15) for k in range(300) for s in ("a", "b") for t in (0, 20 + k % 7, 60)]
    iv = spark.createDataFrame(rows, "k long, source string, start long, end long")

    def found():
        return intervals.active_classes(iv, iv.groupBy("k").agg(F.min("start").alias("start"), F.max("end").alias("end")), ["k"], "source", 2, cell)

    want = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(intervals, "TASK_POINTS", 200)
    out = found()
    assert out.rdd.getNumPartitions() >= 21 and sorted(map(tuple, out.collect())) == want and len(want) > 1000
