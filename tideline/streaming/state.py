"""Streams of intervals with state for each key and event-time timers: unions, and classed chunks.

Both give what `operators.intervals` and `operators.chunks` give for the whole
input, whatever the order and the batches in which its rows come, as far as the
watermark has passed. An interval's event time is its start; the watermark is
the latest start of the batches before, less `late`. A row is late, and dropped,
if its start is not after the watermark that the batch before had. A result that
ends at or before the watermark can't change any more, as what is still to come
starts after it: it goes out then, once, and its state goes with it, so that
state holds only what reaches beyond the watermark, already merged.

The columns `start` and `end` are timestamps; rows without start < end are left
out, null keys are keys. The streams are in append mode.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tideline.operators.intervals import SPEAKERS
from tideline.operators.steps import shared_dir

#: Chunks whose state is one value.
STRETCH = 128
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def union(parts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(parts):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def class_times(sources: list[list[tuple[int, int]]], low: int, high: int, most: int) -> list[int]:
    """For 0 .. most sources active at once, the time between low and high; each source's intervals are disjoint and lie within."""
    times, depth, at = [0] * (most + 1), 0, low
    for t, step in sorted(x for held in sources for s, e in held for x in ((s, 1), (e, -1))):
        times[min(depth, most)] += t - at
        depth, at = depth + step, t
    times[min(depth, most)] += high - at
    return times


def _millis(t: int) -> int:
    """The first whole millisecond at or after t microseconds."""
    return -(-t // 1000)


class _Union(StatefulProcessor):
    """Open intervals of a key; one timer, at the end that the watermark passes first."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "s long, e long")
        self.timer = handle.getValueState("timer", "at long")

    def _keep(self, parts: list[tuple[int, int]]) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if parts:
            self.open.put(parts)
            at = _millis(min(e for _, e in parts))
            self.handle.registerTimer(at)
            self.timer.update((at,))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.open.get()) if self.open.exists() else []
        self._keep(union([*((s, e) for s, e in held), *((r._s, r._e) for r in rows)]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(s, e) for s, e in self.open.get()]
        self._keep([p for p in held if p[1] > passed])
        for s, e in held:
            if e <= passed:
                yield Row(**dict(zip(self.keys, key, strict=True)), _s=s, _e=e)

    def close(self) -> None:
        pass


class _Chunks(StatefulProcessor):
    """The intervals of a key in one stretch of chunks, merged for each source; one timer, at the end of the first chunk that is reached.

    Each call of the state is a message to Spark, so a stretch has one value for all its chunks.
    """

    def __init__(self, keys: list[str], size: int, most: int):
        self.keys, self.size, self.most = keys, size, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, parts array<struct<source: string, s: long, e: long>>")
        self.row = Row(*self.keys, "chunk", "label", "n_tied")

    def _get(self) -> tuple[int | None, dict[str | None, list[tuple[int, int]]]]:
        """The time of the timer, and the intervals by source."""
        at, held = self.held.get() or (None, [])
        by: dict[str | None, list[tuple[int, int]]] = {}
        for source, s, e in held:
            by.setdefault(source, []).append((s, e))
        return at, by

    def _keep(self, by: dict[str | None, list[tuple[int, int]]], timer: int | None) -> None:
        """timer: when one stands."""
        if not by:
            self.held.clear()
            return
        at = _millis((min(parts[0][0] for parts in by.values()) // self.size + 1) * self.size)
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.held.update((at, [(source, s, e) for source, parts in by.items() for s, e in parts]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, by = self._get()
        for r in rows:
            source, s, e = r[-3:]
            by.setdefault(source, []).append((s, e))
        self._keep({source: union(parts) for source, parts in by.items()}, timer)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.size  # the first chunk that may still change
        still: dict[str | None, list[tuple[int, int]]] = {}
        chunks: dict[int, dict[str | None, list[tuple[int, int]]]] = {}
        for source, parts in self._get()[1].items():
            for s, e in parts:
                for chunk in range(s // self.size, min((e - 1) // self.size + 1, passed)):
                    part = (max(s, chunk * self.size), min(e, (chunk + 1) * self.size))
                    chunks.setdefault(chunk, {}).setdefault(source, []).append(part)
                if e > passed * self.size:
                    still.setdefault(source, []).append((max(s, passed * self.size), e))
        self._keep(still, None)
        for chunk, held in chunks.items():
            low = chunk * self.size
            times = class_times(list(held.values()), low, low + self.size, self.most)
            yield self.row(*key[:-1], chunk, SPEAKERS[times.index(max(times))], times.count(max(times)))

    def close(self) -> None:
        pass


def _timed(iv: DataFrame, late: str) -> DataFrame:
    """Intervals with a watermark on their start, and their times in microseconds."""
    return iv.withWatermark("start", late).filter("start < end").withColumns({"_s": F.unix_micros("start"), "_e": F.unix_micros("end")})


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, more: str, *by: str) -> DataFrame:
    """The processor's rows, keys and `more`; its state is by the keys and `by`."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one with such state
    schema = StructType([rows.schema[k] for k in keys])
    for field in StructType.fromDDL(more):
        schema = schema.add(field)
    return rows.groupBy(*keys, *by).transformWithState(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def merged(iv: DataFrame, keys: list[str], late: str) -> DataFrame:
    """keys, start, end: the union of each key's intervals, each interval once the watermark has reached its end.

    A key's open intervals are one task's; finer keys (with the source, say) spread a busy one.
    """
    found = _run(_timed(iv, late).select(*keys, "start", "_s", "_e"), keys, _Union(keys), "_s long, _e long")
    return found.select(*keys, F.timestamp_micros("_s").alias("start"), F.timestamp_micros("_e").alias("end"))


def classed_chunks(iv: DataFrame, keys: list[str], source: str, size: int, sources: int, late: str) -> DataFrame:
    """keys, chunk, label, n_tied: the class of the longest time in each chunk of `size` microseconds that an interval reaches into.

    Chunks count from the epoch. Classes are numbers of sources active at once (`sources` at most), also none; of several
    with the same time the least wins, and n_tied tells how many there were. State is by key and stretch of STRETCH chunks,
    so that few messages go between Spark and Python, and a key with a long past is spread over its stretches.
    """
    if not 0 < sources < len(SPEAKERS):
        raise ValueError(f"sources must be 1 to {len(SPEAKERS) - 1}")
    if "chunk" in keys:
        raise ValueError("no key may be called chunk")
    rows = _timed(iv, late).select(*keys, F.col(source).cast("string").alias("_source"), "start", "_s", "_e")
    width = size * STRETCH
    low, high = F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width)
    # Quotients of whole numbers below 2**53 are doubles; one stretch more on each side, and empty parts go.
    parts = rows.withColumn("_stretch", F.explode(F.sequence(low - 1, high + 1)))
    inside = {"_s": F.greatest("_s", F.col("_stretch") * width), "_e": F.least("_e", (F.col("_stretch") + 1) * width)}
    parts = parts.withColumns(inside).filter("_s < _e").select(*keys, "_stretch", "start", "_source", "_s", "_e")
    return _run(parts, keys, _Chunks(keys, size, sources), "chunk long, label string, n_tied int", "_stretch")


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source has now, and read what it has given."""
    spark = stream.sparkSession
    path, marks = shared_dir(spark), shared_dir(spark)
    spark.createDataFrame([], stream.schema).write.parquet(path)
    run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
