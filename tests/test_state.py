"""Stateful streams against the batch operators, in any order and batching."""

import os
import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.operators import chunks, intervals
from tideline.streaming import state

US = 1_000_000
SCHEMA = "k string, source string, start timestamp, end timestamp"
BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else BASE + timedelta(seconds=seconds)


def stream_of(spark, batches):
    """A stream that gets each batch of (k, source, start, end in seconds) as one file and one micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for i, rows in enumerate(batches):
        part = spark.createDataFrame([(k, s, at(a), at(b)) for k, s, a, b in rows], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):  # files are taken in the order of their times
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{folder}/{name}", f"{folder}/b{i}.parquet")
                os.utime(f"{folder}/b{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def made_up(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        a = rng.randint(0, 2400) / 4
        rows.append((rng.choice(["x", "x", "x", "y", None]), rng.choice(["a", "b", "c"]), a, a + rng.choice([0.25, 1, 3, 7.5, 40])))
    return [*rows, ("x", "a", 5.0, 5.0), ("y", "a", 9.0, 8.0), ("y", "b", 3.0, None), *rows[:5]]


END = [("end", "a", 5000.0, 5001.0)]


def micros(iv):
    return iv.select("k", "source", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))


def split(rows, how):
    rng = random.Random(how)
    rows = rows[:]
    rng.shuffle(rows)
    n = 1 + how
    return [rows[i::n] for i in range(n)]


@pytest.mark.parametrize("how", [0, 3])
def test_union_in_any_order(spark, how):
    rows = made_up(1)
    batch = spark.createDataFrame([(k, s, at(a), at(b)) for k, s, a, b in rows], SCHEMA)
    want = sorted((r.k or "", r.start, r.end) for r in intervals.merge(micros(batch), ["k"]).collect())
    out = state.drained(state.merged(stream_of(spark, [*split(rows, how), END]), ["k"], "1000 seconds"))
    got = out.select("k", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end")).collect()
    assert sorted((r.k or "", r.start, r.end) for r in got) == want and len(want) > 10


@pytest.mark.parametrize("how", [0, 3])
def test_chunks_in_any_order(spark, how):
    rows, size = made_up(2), 10 * US
    batch = micros(spark.createDataFrame([(k or "-", s, at(a), at(b)) for k, s, a, b in rows], SCHEMA))
    reached = chunks.overlaps(intervals.well_formed(batch), ["k"], size).select("k", "chunk").distinct()
    spans = reached.select("k", (F.col("chunk") * size).alias("start"), ((F.col("chunk") + 1) * size).alias("end"))
    classes = intervals.active_classes(batch, spans, ["k"], "source", 2).withColumn("priority", F.col("cls"))
    named = classes.withColumn("label", F.get(F.array(*map(F.lit, intervals.SPEAKERS)), F.col("cls").cast("int")))
    want = sorted(tuple(r) for r in chunks.majority(named, reached, ["k"], size).collect())
    out = state.drained(state.classed_chunks(stream_of(spark, [*split(rows, how), END]), ["k"], "source", size, 2, "1000 seconds"))
    got = sorted((r.k or "-", r.chunk, r.label, r.n_tied) for r in out.collect() if r.k != "end")
    assert got == want and len({w[2] for w in want}) == 3


def test_state_has_few_entries(spark):
    """400 chunks of a key go through some entries of state, not through one each, and come out over several batches."""
    rows = [("x", "ab"[i % 2], float(10 * i + 1), float(10 * i + 7 + 8 * (i % 3))) for i in range(400)]
    stream = state.classed_chunks(stream_of(spark, [rows[:150], rows[100:], END]), ["k"], "source", 10 * US, 2, "1000 seconds")
    query = stream.writeStream.format("memory").queryName("few_entries").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    updated = sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators)
    got = sorted((r.chunk - int(BASE.timestamp()) // 10, r.label) for r in spark.table("few_entries").collect())
    assert [c for c, _ in got] == list(range(got[-1][0] + 1)) and len(got) >= 400 and updated < 100


def test_late_rows_and_what_is_open(spark):
    """The batch before the last has the watermark at 90 s: the last one's first row is late; what ends after 190 s isn't out at the end."""
    batches = [[("x", "a", 0.0, 20.0), ("x", "a", 15.0, 95.0)], [("x", "a", 100.0, 110.0)], [("x", "a", 100.0, 101.0)], [("x", "a", 80.0, 99.0), ("x", "a", 92.0, 96.0), ("x", "a", 200.0, 201.0), ("x", "a", 150.0, 190.0)]]
    out = state.drained(state.merged(stream_of(spark, batches), ["k"], "10 seconds")).collect()
    us = lambda t: t.replace(tzinfo=None) - BASE.replace(tzinfo=None)
    got = sorted((us(r.start).total_seconds(), us(r.end).total_seconds()) for r in out)
    assert got == [(0.0, 96.0), (100.0, 110.0), (150.0, 190.0)]


def test_small_parts():
    assert state.union([(3, 4), (1, 2), (2, 3), (6, 9), (7, 8)]) == [(1, 4), (6, 9)]
    assert state.class_times([[(1, 4), (6, 9)], [(3, 7)]], 0, 10, 2) == [2, 6, 2]
    assert state.class_times([], 0, 10, 2) == [10, 0, 0]
