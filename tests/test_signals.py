"""Signals in blocks against one-array code, and WAV files by ranges against the standard library."""

import math
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import chunks, signals
from tideline.sources import wav


def together(cut):
    """id: the whole signal of its blocks."""
    out = {}
    for r in sorted(cut.collect(), key=lambda r: (r.id, r["first"])):
        whole = out.setdefault(r.id, [])
        assert len(whole) == r["first"]
        whole.extend(r.x)
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    whole = {i: rng.normal(size=n) for i, n in enumerate((1, 5, 64, 700, 1000))}
    rows = [(i, [float(v) for v in x]) for i, x in whole.items()] + [(8, []), (9, None)]
    return whole, spark.createDataFrame(rows, "id long, amp array<double>")


@pytest.mark.parametrize(("rate", "to"), [(16000, 24000), (3, 2), (44100, 16000), (8000, 16000), (5, 5)])
def test_resample_by_any_blocks(made, rate, to):
    whole, df = made
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps = signals.low_pass(up, down, 8)
    for size in (13, 100, 4096):
        got = together(signals.resample(signals.blocks(df, ["id"], "amp", size), ["id"], size, rate, to))
        for i, x in whole.items():
            stretched = np.zeros(len(x) * up)
            stretched[::up] = x
            want = np.convolve(stretched, taps)[len(taps) // 2 :][: len(stretched)][::down]
            assert np.abs(got[i] - want[: len(got[i])]).max() < 1e-9 and len(got[i]) == math.ceil(len(x) * up / down)
        assert set(got) == set(whole)


def test_resampled_sine_stays_a_sine(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    cut = signals.blocks(spark.createDataFrame([(1, x.tolist())], "id long, amp array<double>"), ["id"], "amp", 1000)
    y = together(signals.resample(cut, ["id"], 1000, 16000, 8000, side=32))[1]
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000))[200:-200].max() < 1e-3


def test_reverb_by_any_blocks(made):
    whole, df = made
    r = [0.9**j * math.cos(j) for j in range(150)]
    for size in (40, 151, 2000):
        got = together(signals.reverb(signals.blocks(df, ["id"], "amp", size), ["id"], size, r))
        assert all(np.abs(got[i] - np.convolve(x, r)).max() < 1e-9 for i, x in whole.items()) and set(got) == set(whole)


def test_noise_follows_seed_and_place_only(spark, made):
    whole, df = made
    cut = signals.blocks(df, ["id"], "amp", 64)
    one = together(signals.add_noise(cut, ["id"], 6.0, 3))
    other = together(signals.add_noise(signals.blocks(df.repartition(7), ["id"], "amp", 9), ["id"], 6.0, 3))
    for i, x in whole.items():
        assert np.abs(one[i] - other[i]).max() < 1e-12
        assert math.isclose(10 * math.log10((x @ x) / ((one[i] - x) @ (one[i] - x))), 6.0, abs_tol=1e-9)
    assert np.abs(together(signals.add_noise(cut, ["id"], 6.0, 4))[3] - one[3]).max() > 0.01
    added = one[4] - whole[4]
    assert abs(added.mean()) < 0.1 and 0.6 < (np.abs(added) < added.std()).mean() < 0.76  # as a normal distribution has it
    short = together(signals.add_noise(cut, ["id"], 6.0, 3, every=50, length=10))
    changed = np.flatnonzero(short[4] != whole[4])
    assert len(changed) == 200 and all(len(set(changed[k : k + 10] // 50)) == 1 and np.ptp(changed[k : k + 10]) == 9 for k in range(0, 200, 10))
    silent = signals.blocks(spark.createDataFrame([(1, [0.0] * 9)], "id long, amp array<double>"), ["id"], "amp", 4)
    assert not together(signals.add_noise(silent, ["id"], 0.0))[1].any()


def write(path, rate, channels, width, n, seed=0):
    raw = np.random.default_rng(seed).integers(0, 256, n * channels * width, np.uint8).tobytes()
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)


def test_wav_blocks_equal_whole_files(spark, tmp_path):
    for k, (channels, width) in enumerate([(1, 2), (2, 2), (1, 1), (2, 3), (1, 4)]):
        write(tmp_path / f"f{k}.wav", 8000, channels, width, 1000 + k, k)
    write(tmp_path / "empty.wav", 8000, 1, 2, 0)
    (tmp_path / "broken.wav").write_bytes(b"no wave at all")
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "cut.wav").write_bytes((tmp_path / "f0.wav").read_bytes()[:999])
    plain = (tmp_path / "f0.wav").read_bytes()
    (tmp_path / "tagged.wav").write_bytes(b"RIFF" + struct.pack("<I", len(plain) + 4) + b"WAVELIST" + struct.pack("<I", 3) + b"abc\0" + plain[12:])  # an odd chunk comes first
    headers = wav.wav_headers(spark, str(tmp_path))
    rows = {r.file_name: r for r in headers.collect()}
    assert rows["broken"].file_type is None and rows["short"].file_type is None and rows["empty"].n_samples == 0 and rows["cut"].n_samples == (999 - 44) // 2
    got = {}
    for r in sorted(wav.wav_blocks(headers, 300).collect(), key=lambda r: (r.file_name, r["first"])):
        got.setdefault(r.file_name, []).extend(r.x)
    whole = {r.file_name: r.amp for r in wav.read_wav(spark, str(tmp_path)).collect() if r.file_type and r.amp and r.file_name != "cut"}
    assert len(whole) == 6 and [n for n, x in whole.items() if got[n] != x] == []
    assert set(got) == {*whole, "cut"} and got["cut"] == whole["f0"][: rows["cut"].n_samples]
    assert got["tagged"] == got["f0"] and rows["f1"].channels == 2 and rows["f1"].duration == 1001 / 8000


def test_wav_header_scan_reads_little_and_large_files_work(spark, tmp_path):
    """A sparse file of over 2 GB, with samples at its end only."""
    n, counts = 1_200_000_000, tmp_path / "counts"
    counts.mkdir()
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + 2 * n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 2 * n))
        f.seek(44 + 2 * (n - 3))
        f.write(struct.pack("<3h", 1, -2, 16384))
    folder = str(counts)

    class Counted:
        def __init__(self, path):
            self.f, self.n = wav.open_path(path), 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            with open(os.path.join(folder, str(self.n)), "w"):
                self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, size):
            out = self.f.read(size)
            self.n += len(out)
            return out

    headers = wav.wav_headers(spark, str(tmp_path), Counted)
    (row,) = headers.collect()
    assert row.n_samples == n and row.duration == n / 16000
    assert os.listdir(folder) and all(int(name) < 1 << 16 for name in os.listdir(folder))
    plan = wav.wav_headers(spark, str(tmp_path)).withColumn("n_samples", F.col("n_samples"))
    last = wav.wav_blocks(plan, 1 << 20).filter(f"block = {(n - 1) >> 20}").collect()
    assert len(last) == 1 and list(last[0].x[-3:]) == [1 / 32768, -2 / 32768, 0.5] and last[0]["first"] + len(last[0].x) == n


def test_sparse_rule_on_chunk_borders(spark):
    lab = spark.createDataFrame([("a", "non_speech", 1.2, 1.8)], "k string, label string, start double, end double")
    grid = chunks.grid(spark.createDataFrame([("a", 3.0)], "k string, d double"), ["k"], "d", 0.6, "full")
    got = {r.chunk: r.label for r in chunks.sparse_rule(lab, grid, ["k"], 0.6, decimals=1).collect()}
    assert got[2] == "non_speech" and {v for k, v in got.items() if k != 2} == {"two_spk"}
