"""Stretched and shifted signals in blocks against one-array code, and sines by their length and pitch."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tests.test_signals import together
from tideline.operators import signals, stretch


def vocoder(x, speed, width):
    """The phase vocoder of one array: phases go on by the frequency that each bin is found to have."""
    hop, length = width // 4, math.ceil(len(x) / speed)
    window = np.hanning(width + 1)[:-1]
    padded = np.concatenate([np.zeros(width // 2), x, np.zeros(len(x) + 12 * width)])
    spectrum = lambda k: np.fft.rfft(padded[k * hop : k * hop + width] * window)
    middle = 2 * np.pi * hop * np.arange(width // 2 + 1) / width
    out, weight = np.zeros(length + 4 * width), np.zeros(length + 4 * width)
    phase = np.angle(spectrum(0))
    for t in range((length + width // 2) // hop + 1):
        k, past = int(t * speed), float(t * speed % 1)
        a, b = spectrum(k), spectrum(k + 1)
        frame = np.fft.irfft(((1 - past) * abs(a) + past * abs(b)) * np.exp(1j * phase), width)
        out[t * hop : t * hop + width] += frame * window
        weight[t * hop : t * hop + width] += window**2
        off = np.angle(b) - np.angle(a) - middle
        phase = phase + middle + off - 2 * np.pi * np.round(off / (2 * np.pi))
    return (out / np.maximum(weight, 1e-9))[width // 2 :][:length]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    whole = {i: rng.normal(size=n) for i, n in enumerate((1, 5, 64, 257, 700, 1031))}
    rows = [(i, [float(v) for v in x]) for i, x in whole.items()] + [(8, []), (9, None)]
    return whole, spark.createDataFrame(rows, "id long, amp array<double>")


@pytest.mark.parametrize(("speed", "size"), [("3/2", 100), ("1/4", 64), ("1", 37), ("4", 256), ("7/5", 5000), ("13/16", 9)])
def test_stretch_by_any_blocks(made, speed, size):
    whole, df = made
    speed = Fraction(speed)
    got = together(stretch.stretch(signals.blocks(df, ["id"], "amp", size), ["id"], size, speed, 64))
    assert set(got) == set(whole)
    for i, x in whole.items():
        assert len(got[i]) == math.ceil(len(x) / speed)
        assert np.abs(got[i] - vocoder(x, speed, 64)).max() < 1e-8, (i, speed)


def peak(x):
    """The frequency of the strongest bin, in parts of the rate."""
    x = x[len(x) // 8 : -len(x) // 8]
    return np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x))))) / len(x)


def test_sines_keep_pitch_or_length(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    cut = signals.blocks(spark.createDataFrame([(1, x.tolist())], "id long, amp array<double>"), ["id"], "amp", 1500)
    for speed in (0.5, 1.25, 2):
        y = together(stretch.stretch(cut, ["id"], 1500, speed))[1]
        assert len(y) == 16000 / speed and abs(peak(y) * 16000 - 440) < 4
        assert 0.6 < np.sqrt(np.mean(y[1000:-1000] ** 2)) < 0.75  # as loud as before
    for steps in (-5, 4, 12):
        y = together(stretch.shift_pitch(cut, ["id"], 1500, stretch.semitones(steps)))[1]
        assert len(y) == 16000 and abs(peak(y) * 16000 - 440 * 2 ** (steps / 12)) < 4


def test_silence_stays_silent_and_speed_is_checked(spark):
    cut = signals.blocks(spark.createDataFrame([("a", 2, [0.0] * 90)], "id string, other long, amp array<double>"), ["id", "other"], "amp", 40)
    rows = stretch.stretch(cut, ["id", "other"], 40, 0.5, 16).collect()
    assert sum(len(r.x) for r in rows) == 180 and not any(any(r.x) for r in rows) and {(r.id, r.other) for r in rows} == {("a", 2)}
    assert stretch.stretch(cut.limit(0), ["id", "other"], 40, 2).count() == 0
    for speed, width in ((0, 16), (-1, 16), (1, 6)):
        with pytest.raises(ValueError, match="speed"):
            stretch.stretch(cut, ["id", "other"], 40, speed, width)
