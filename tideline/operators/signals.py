"""Long signals as rows of blocks: resampling, reverb and noise.

A block is a row (keys, block, first, x): x are the samples from number `first` = block * size on.
A signal of any length is many rows, and no step brings more than a few blocks of it into one task:
neighbours meet by (keys, block), sums over a signal are partial sums that come back by its keys.

Defined cases: a null or empty signal has no blocks and so no result; samples outside a signal are
zero; null samples count as zero. Results don't depend on the size of blocks, on partitions or on
retries (up to rounding in sums).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(rows: DataFrame, keys: list[str], signal: str, size: int) -> DataFrame:
    """The blocks of `size` samples of each row's signal."""
    x = F.transform(signal, lambda s: F.coalesce(s.cast("double"), F.lit(0.0)))
    starts = F.sequence(F.lit(0), F.size(signal) - 1, F.lit(size))
    cut = F.transform(starts, lambda s: F.struct(F.floor(s / size).alias("block"), s.cast("long").alias("first"), F.slice("_x", s + 1, size).alias("x")))
    held = rows.filter(F.size(signal) > 0).select(*keys, x.alias("_x"), signal)
    return held.select(*keys, F.explode(cut).alias("b")).select(*keys, "b.block", "b.first", "b.x")


def small_batches(cut: DataFrame, size: int) -> None:
    """Let Arrow batches hold about 2**22 samples at most from now on in this session; a smaller setting stays."""
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", max(1, (1 << 22) // size)
    if not 0 < int(cut.sparkSession.conf.get(name, "10000")) <= rows:
        cut.sparkSession.conf.set(name, str(rows))


def samples(cut: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, x: a row for each sample."""
    return cut.select(*keys, "first", F.posexplode("x").alias("p", "x")).select(*keys, (F.col("first") + F.col("p")).alias("i"), "x")


def with_halo(cut: DataFrame, keys: list[str], size: int, halo: int) -> DataFrame:
    """keys, block, at, x: each block with `halo` samples of its neighbours on both sides; x begins at sample `at`.

    A block goes to its neighbours with no more than the samples that they need.
    """
    reach = -(-halo // size)
    to = cut.withColumn("to", F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0).cast("long")), F.col("block") + reach)))
    low = F.greatest(F.col("to") * size - halo, F.col("first"))
    high = F.least((F.col("to") + 1) * size + halo, F.col("first") + F.size("x"))
    to = to.filter(high > low).select(*keys, "to", low.alias("at"), F.slice("x", (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).alias("x"), (F.col("to") == F.col("block")).alias("own"))
    met = to.groupBy(*keys, F.col("to").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("parts"), F.max("own").alias("own"))
    return met.filter("own").select(*keys, "block", F.get("parts", F.lit(0))["at"].alias("at"), F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))


def low_pass(up: int, down: int, side: int) -> np.ndarray:
    """Hann-windowed sinc at the common rate: cut off at the lower of the two rates, `side` zero crossings on each side."""
    widest = max(up, down)
    half = side * widest
    j = np.arange(-half, half + 1)
    return up / widest * np.sinc(j / widest) * 0.5 * (1 + np.cos(np.pi * j / (half + 1)))


def resample(cut: DataFrame, keys: list[str], size: int, rate: int, to_rate: int, side: int = 8) -> DataFrame:
    """keys, block, first, x: the blocks at another rate; sample m stands at time m / to_rate.

    A polyphase filter: sample m is the sum of x[k] * h[m * down - k * up] over the few k within
    the filter, found by index arithmetic. A block makes the samples that lie in its own time.
    """
    small_batches(cut, size)
    common = math.gcd(rate, to_rate)
    up, down = to_rate // common, rate // common
    taps = low_pass(up, down, side)
    half = len(taps) // 2
    halo = half // up + 1
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block long, first long, x array<double>"])
    ends = cut.select(*keys, "block", (F.col("first") + F.size("x")).alias("_end"))
    rows = with_halo(cut, keys, size, halo).join(ends, [*keys, "block"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            first, out = [], []
            for block, at, x, end in zip(f["block"], f["at"], f["x"], f["_end"], strict=True):
                m = np.arange(-(-block * size * up // down), -(-end * up // down))
                k = -(-(m * down - half)[:, None] // up) + np.arange(2 * half // up + 1)
                tap = (m * down)[:, None] - k * up + half
                inside = (k >= at) & (k < at + len(x)) & (tap >= 0) & (tap < len(taps))
                held = np.asarray(x)[np.where(inside, k - at, 0)] * taps[np.where(inside, tap, 0)]
                first.append(int(m[0]) if len(m) else 0)
                out.append(np.where(inside, held, 0.0).sum(1))
            yield pd.DataFrame({**{k: f[k] for k in keys}, "block": f["block"], "first": first, "x": out})

    return rows.mapInPandas(run, schema).filter(F.size("x") > 0)


def reverb(cut: DataFrame, keys: list[str], size: int, response: list[float]) -> DataFrame:
    """keys, block, first, x: the blocks convolved with an impulse response of any length (a parameter of fixed size).

    Overlap-add: each block times each partition of the response makes parts of two output blocks,
    and the parts of a block are added up in the order of their origin.
    """
    small_batches(cut, size)
    r = np.asarray(response, float)
    pieces = [r[p : p + size] for p in range(0, len(r), size)]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block long, of long, x array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            index, block, of, out = [], [], [], []
            for i, b, x in zip(f.index, f["block"], f["x"], strict=True):
                for p, piece in enumerate(pieces):
                    y = np.convolve(x, piece)
                    for q, part in enumerate((y[:size], y[size:])):
                        if len(part):
                            index.append(i), block.append(b + p + q), of.append(b), out.append(part)
            yield pd.DataFrame({**{k: f[k].loc[index].to_numpy() for k in keys}, "block": block, "of": of, "x": out})

    return added(cut.select(*keys, "block", "x").mapInPandas(run, schema), keys, size)


def added(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, block, first, x: the sums of the parts (keys, block, of, x) of each output block, in the order of their origin `of`."""
    met = parts.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("of", "x"))).alias("parts"))
    add = lambda a, b: F.zip_with(a, b, lambda s, t: F.coalesce(s, F.lit(0.0)) + F.coalesce(t, F.lit(0.0)))
    total = F.aggregate("parts", F.array().cast("array<double>"), lambda acc, p: add(acc, p["x"]))
    return met.select(*keys, "block", (F.col("block") * size).alias("first"), total.alias("x"))


def uniform(seed: int, what: str, part: int, *counter: Column) -> Column:
    """A number in [0, 1) that depends on the seed, what it is for and the counter only: 32 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{what}"), *[c.cast("string") for c in counter]).cast("binary"))
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def gaussian(seed: int, *counter: Column) -> Column:
    """A standard normal number for each counter."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, "noise", 0, *counter))) * F.cos(2 * math.pi * uniform(seed, "noise", 1, *counter))


def add_noise(cut: DataFrame, keys: list[str], ratio: float, seed: int = 0, every: int | None = None, length: int = 0) -> DataFrame:
    """The blocks with Gaussian noise, `ratio` dB below the signal; over a whole signal the ratio is exact.

    every, length: noise in short pieces only, of `length` samples at a random place in each `every`
    samples. The noise of a sample depends on seed, keys and its number alone. A silent signal, and
    one without noise, stays as it is.
    """
    at = lambda i: F.col("first") + i
    own = [F.col(k) for k in keys]
    noise = lambda i: gaussian(seed, *own, at(i))
    if every:
        start = lambda i: F.floor(uniform(seed, "place", 0, *own, F.floor(at(i) / every)) * (every - length + 1))
        inside = lambda i: (F.pmod(at(i), F.lit(every)) >= start(i)) & (F.pmod(at(i), F.lit(every)) < start(i) + length)
        value = lambda i: F.when(inside(i), noise(i)).otherwise(F.lit(0.0))
    else:
        value = noise
    noisy = cut.withColumn("_noise", F.transform("x", lambda _, i: value(i)))
    power = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y))
    sums = noisy.groupBy(*keys).agg(power("x").alias("_signal"), power("_noise").alias("_sum"))
    gain = F.when((F.col("_signal") > 0) & (F.col("_sum") > 0), F.sqrt(F.col("_signal") / (F.col("_sum") * 10.0 ** (ratio / 10)))).otherwise(F.lit(0.0))
    gains = sums.select(*keys, gain.alias("_gain"))
    return noisy.join(gains, keys).select(*keys, "block", "first", F.zip_with("x", "_noise", lambda s, e: s + e * F.col("_gain")).alias("x"))
