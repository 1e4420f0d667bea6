"""Time stretching and pitch shifting of long signals in blocks (see `signals`): a phase vocoder.

Analysis frame k is the windowed signal around sample k * hop, synthesis frame t takes its magnitudes
from position t * speed between two analysis frames, and its phases go on from frame to frame by what
they gain between those two. A block owns the frames whose analysis position lies in its time. What
passes between blocks is one phase for each block and frequency: the running sum of all gains before
it, so no task sees a whole signal.

Defined cases: as in `signals`. A signal of n samples becomes ceil(n / speed) long by `stretch` and
stays n long by `shift_pitch`. A frequency without magnitude has phase 0. Results don't depend on
the size of blocks (up to rounding in sums).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import signals

#: Frames that are transformed at once.
_BATCH = 256


class Frames(NamedTuple):
    """Frames of `width` samples, a quarter of it apart in the output; `speed` is exact."""

    width: int
    speed: Fraction

    @property
    def hop(self) -> int:
        return self.width // 4

    @property
    def halo(self) -> int:
        """What a block's frames reach beyond it, and enough to know the signal's end wherever they must stop short of it."""
        return math.ceil(max(1, self.speed) * (self.width // 2)) + self.hop

    def window(self) -> np.ndarray:
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(self.width) / self.width)

    def owned(self, block: int, size: int, end: int) -> tuple[range, int | None]:
        """The synthesis frames of a block whose known samples (halo included) end at `end`, and the output's length if the end is the signal's."""
        first = lambda b: math.ceil(Fraction(-(-b * size // self.hop)) / self.speed)
        low, high = first(block), first(block + 1)
        if end >= (block + 1) * size + self.halo:
            return range(low, high), None
        length = math.ceil(end / self.speed)
        last = (length - 1 + self.width // 2) // self.hop + 1
        return range(low, last if end <= (block + 1) * size else min(high, last)), length

    def spectra(self, x: np.ndarray, at: int, frames: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spectra before and after each frame's analysis position, and how far it is between them."""
        n, d = self.speed.numerator, self.speed.denominator
        t = np.arange(frames.start, frames.stop)
        k, past = t * n // d, (t * n % d) / d
        each, where = np.unique(np.concatenate([k, k + 1]), return_inverse=True)
        i = (each * self.hop - self.width // 2 - at)[:, None] + np.arange(self.width)
        inside = (i >= 0) & (i < len(x))
        spectra = np.fft.rfft(np.where(inside, x[np.where(inside, i, 0)], 0.0) * self.window())
        return spectra[where[: len(t)]], spectra[where[len(t) :]], past

    def weight(self, m: np.ndarray) -> np.ndarray:
        """The sum of the squared windows over output sample m."""
        squares, reach = self.window() ** 2, m + self.width // 2
        t = (reach // self.hop)[:, None] - np.arange(4)
        return np.where(t >= 0, squares[reach[:, None] - t * self.hop], 0.0).sum(1)


def _batches(frames: range) -> Iterator[range]:
    return (frames[i : i + _BATCH] for i in range(0, len(frames), _BATCH))


def _gains(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.angle(after) - np.angle(before)


def advance(f: Frames, size: int, block: int, at: int, x: np.ndarray) -> np.ndarray:
    """What the frames of a block add to the phases of all frames after it; the first block begins with its first frame's phases."""
    frames, _ = f.owned(block, size, at + len(x))
    total = np.zeros(f.width // 2 + 1)
    for part in _batches(frames):
        before, after, _ = f.spectra(x, at, part)
        if part.start == 0:
            total += np.angle(before[0])
        total = np.remainder(total + _gains(before, after).sum(0), 2 * np.pi)
    return total


def sound(f: Frames, size: int, block: int, at: int, x: np.ndarray, phase: np.ndarray) -> tuple[int, np.ndarray]:
    """What the frames of a block add to the output, and its first sample there."""
    frames, length = f.owned(block, size, at + len(x))
    if not len(frames):
        return 0, np.zeros(0)
    half = f.width // 2
    low = frames.start * f.hop - half
    out = np.zeros((len(frames) - 1) * f.hop + f.width)
    for part in _batches(frames):
        before, after, past = f.spectra(x, at, part)
        if part.start == 0:
            phase = phase + np.angle(before[0])
        gains = _gains(before, after)
        phases = phase + np.cumsum(gains, 0) - gains
        phase = np.remainder(phase + gains.sum(0), 2 * np.pi)
        past = past[:, None]
        y = np.fft.irfft(((1 - past) * np.abs(before) + past * np.abs(after)) * np.exp(1j * phases), f.width) * f.window()
        for t, row in zip(part, y, strict=True):
            out[t * f.hop - half - low :][: f.width] += row
    m = np.arange(max(low, 0), low + len(out) if length is None else min(low + len(out), length))
    return int(m[0]) if len(m) else 0, out[m - low] / f.weight(m)


def _mapped(rows: DataFrame, keys: list[str], fields: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """keys and the fields that `make` yields for each row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [field.split()[0] for field in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(i, *out) for i, row in zip(frame.index, frame.drop(columns=keys).to_dict("records"), strict=True) for out in make(**row)]
            origin = [m[0] for m in made]
            yield pd.DataFrame({**{k: frame[k].loc[origin].to_numpy() for k in keys}, **{n: [m[j + 1] for m in made] for j, n in enumerate(names)}})

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), fields]))


def stretch(cut: DataFrame, keys: list[str], size: int, speed: float | Fraction, width: int = 1024) -> DataFrame:
    """keys, block, first, x: the blocks played at `speed` (2 halves their length) with their pitch as it was.

    width, a multiple of four, is the length of a frame. A speed that is not a fraction of small numbers is taken to 1/1000.
    """
    speed = speed if isinstance(speed, Fraction) else Fraction(speed).limit_denominator(1000)
    if speed <= 0 or width < 4 or width % 4:
        raise ValueError("speed must be over zero, width a multiple of four")
    signals.small_batches(cut, size)
    f = Frames(width, speed)
    whole = signals.with_halo(cut, keys, size, f.halo)

    def gained(block: int, at: int, x: np.ndarray) -> Iterator[tuple]:
        yield block, advance(f, size, block, at, x)

    def parts(block: int, at: int, x: np.ndarray, phase: np.ndarray | None) -> Iterator[tuple]:
        first, y = sound(f, size, block, at, x, np.zeros(width // 2 + 1) if phase is None else phase)
        for b in range(first // size, -(-(first + len(y)) // size)):
            low, high = max(b * size, first), min((b + 1) * size, first + len(y))
            yield b, block, np.concatenate([np.zeros(low - b * size), y[low - first : high - first]])

    one = _mapped(whole, keys, "block long, gain array<double>", gained).select(*keys, "block", F.posexplode("gain").alias("bin", "gain"))
    before = Window.partitionBy(*keys, "bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = one.withColumn("gain", F.coalesce(F.sum("gain").over(before), F.lit(0.0)))
    phases = carried.groupBy(*keys, "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "gain"))), lambda p: p["gain"]).alias("phase"))
    made = _mapped(whole.join(phases, [*keys, "block"], "left"), keys, "block long, of long, x array<double>", parts)
    return signals.added(made, keys, size)


def shift_pitch(cut: DataFrame, keys: list[str], size: int, ratio: float | Fraction, width: int = 1024, side: int = 8) -> DataFrame:
    """keys, block, first, x: the blocks with every frequency times `ratio` and their length as it was.

    Stretched by the ratio, then resampled back. A ratio that is not a fraction of small numbers is taken to 1/100; see `semitones`.
    """
    ratio = ratio if isinstance(ratio, Fraction) else Fraction(ratio).limit_denominator(100)
    longer = stretch(cut, keys, size, 1 / ratio, width)
    back = signals.resample(longer, keys, size, ratio.numerator, ratio.denominator, side)
    ends = cut.groupBy(*keys).agg(F.max(F.col("first") + F.size("x")).alias("_end"))
    kept = F.slice("x", F.lit(1), F.greatest(F.least(F.size("x"), F.col("_end") - F.col("first")), F.lit(0)).cast("int"))
    return back.join(ends, keys).select(*keys, "block", "first", kept.alias("x")).filter(F.size("x") > 0)


def semitones(steps: float) -> Fraction:
    """The ratio of frequencies `steps` semitones apart, within 1/100."""
    return Fraction(2 ** (steps / 12)).limit_denominator(100)
