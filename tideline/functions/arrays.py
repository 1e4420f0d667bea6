"""Array and interval-array expressions. Intervals are structs with `start` and `end`; positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice0(a: Column, start: Column, stop: Column) -> Column:
    """a[start:stop], half open, clamped to the array."""
    first = F.greatest(start, F.lit(0))
    return F.slice(a, first + 1, F.greatest(F.least(stop, F.size(a)) - first, F.lit(0)))


def _chunks(a: Column, size: int, n: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: slice0(a, i * size, (i + 1) * size))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(a), 1, 0))


def full_chunks(a: Column, size: int) -> Column:
    """Non-overlapping chunks of `size`; what doesn't fill one is left out."""
    return _chunks(a, size, F.floor(F.size(a) / size).cast("int"))


def tail_chunks(a: Column, size: int) -> Column:
    """Non-overlapping chunks of `size`; the last may be shorter."""
    return _chunks(a, size, F.ceil(F.size(a) / size).cast("int"))


def fixed_chunks(a: Column, size: int, n: Column) -> Column:
    """The first n chunks of `size`, empty ones where the signal has ended."""
    return _chunks(a, size, n.cast("int"))


def trim_common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both arrays cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def drop_last(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def positions_of(a: Column, value: Column) -> Column:
    """Positions at which the array holds value."""
    at = F.transform(a, lambda x, i: F.when(x == value, i))
    return F.filter(at, lambda i: i.isNotNull())


def gather(a: Column, at: Column, shift: int = 0) -> Column:
    """The values at the given positions, each moved by shift."""
    return F.transform(at, lambda i: F.get(a, i + shift))


def zip_intervals(starts: Column, ends: Column) -> Column:
    """Starts and ends as intervals; the longer list's rest is left out."""
    s, e = trim_common(starts, ends)
    return F.zip_with(s, e, lambda x, y: F.struct(x.alias("start"), y.alias("end")))


def pad_truncate(a: Column, n: int, kind: str = "float") -> Column:
    """Exactly n values: cut, or filled up with zeros."""
    zeros = F.array_repeat(F.lit(0).cast(kind), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(F.slice(a, 1, n), zeros)


def argmax(a: Column) -> Column:
    """Position of the first greatest value; null for an empty array."""
    at = (F.array_position(a, F.array_max(a)) - 1).cast("int")
    return F.when(F.size(a) > 0, at)


def power(a: Column) -> Column:
    """Mean of squares in double; null for an empty array."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.try_divide(total, F.size(a))


def snr(signal: Column, noise: Column) -> Column:
    """10 log10(signal / noise); null where either power is missing or the noise is zero."""
    return 10 * F.log10(F.try_divide(signal, noise))


def total_length(intervals: Column, zero: Column | None = None) -> Column:
    """Sum of end - start, in the order of the array."""
    return F.aggregate(intervals, F.lit(0.0) if zero is None else zero, lambda s, x: s + (x["end"] - x["start"]))


def drop_empty(intervals: Column) -> Column:
    """Intervals whose start and end differ."""
    return F.filter(intervals, lambda x: x["start"] != x["end"])


def intersect(a: Column, b: Column) -> Column:
    """All pairs' common parts in the order of a, then b; touching intervals have none."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end")))))
    return F.filter(pairs, lambda x: x["start"] < x["end"])


def intersect_all(first: Column, *others: Column) -> Column:
    """Left fold of `intersect`."""
    for other in others:
        first = intersect(first, other)
    return first


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def merge(intervals: Column) -> Column:
    """Sorted union; touching intervals join; reversed and null ones don't count.

    With starts and ends sorted on their own, an island begins at every start i
    that lies after end i - 1: then all i earlier intervals have ended.
    """
    sound = F.filter(intervals, lambda x: x["start"] <= x["end"])
    sides = F.struct(F.array_sort(F.transform(sound, lambda x: x["start"])).alias("s"), F.array_sort(F.transform(sound, lambda x: x["end"])).alias("e"))

    def islands(p: Column) -> Column:
        first = F.transform(p["s"], lambda x, i: F.when((i == 0) | (F.get(p["e"], i - 1) < x), i))
        return bind(F.filter(first, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda i, k: F.struct(F.get(p["s"], i).alias("start"), F.get(p["e"], F.coalesce(F.get(at, k + 1), F.size(p["e"])) - 1).alias("end"))))

    return bind(sides, islands)


def complement(intervals: Column, start: Column, end: Column) -> Column:
    """What of [start, end] the intervals leave; they may overlap, touch, be unsorted or lie outside."""
    inside = F.transform(intervals, lambda x: F.struct(F.greatest(x["start"], start).alias("start"), F.least(x["end"], end).alias("end")))
    solid = merge(F.filter(inside, lambda x: x["start"] < x["end"]))

    def gaps(held: Column) -> Column:
        starts = F.concat(F.array(start), F.transform(held, lambda x: x["end"]))
        ends = F.concat(F.transform(held, lambda x: x["start"]), F.array(end))
        return F.filter(zip_intervals(starts, ends), lambda x: x["start"] < x["end"])

    return bind(solid, gaps)


def first_of_each(labelled: Column) -> Column:
    """Labelled intervals without those of zero length and without repeats of a (start, end): the first stays."""
    placed = F.transform(drop_empty(labelled), lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), x.alias("x")))

    def firsts(p: Column) -> Column:
        same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
        kept = F.filter(p, lambda x, k: (k == 0) | ~same(x, F.get(p, F.greatest(k - 1, F.lit(0)))))
        return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda y: y["x"])

    return bind(F.array_sort(placed), firsts)


def sort_by_start(intervals: Column) -> Column:
    """Sorted by start alone; intervals that start together keep their order."""
    placed = F.transform(intervals, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda y: y["x"])


def period_of(nested: Column) -> Column:
    """end - start of [start, end], or null if the list is too short."""
    return F.try_element_at(nested, F.lit(2)) - F.try_element_at(nested, F.lit(1))
