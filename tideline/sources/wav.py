"""WAV files: whole small ones as binary files; headers and blocks of samples of files of any size by ranges.

A header scan reads the headers of a file's chunks by their offsets and none of its samples. Its
rows are the plan of a block scan, in which each block of samples is a row of its own, read by seek
in any task. Ranges are read through pyarrow's file systems (local, HDFS, S3 and others, by the
path's scheme). RF64 files (over 4 GB) and cut files are read as far as they go.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import last_part


def wav_path(split: str, wave_type: str, mix: str, audio_id: Column) -> Column:
    """wave_type/max/split/mix/id.wav"""
    return F.concat(F.lit(f"{wave_type}/max/{split}/{mix}/"), audio_id, F.lit(".wav"))


def sparse_path(audio_id: Column, rate: str, subset: str, dashed: bool = False) -> Column:
    """folder/rate/subset/folder-file.wav of folder/file; dashed: underscores in the folder become dashes."""
    folder = F.split_part(audio_id, F.lit("/"), F.lit(1))
    folder = F.replace(folder, F.lit("_"), F.lit("-")) if dashed else folder
    return F.concat_ws("/", folder, F.lit(rate), F.lit(subset), F.concat(folder, F.lit("-"), F.split_part(audio_id, F.lit("/"), F.lit(2)), F.lit(".wav")))


def decode(content: bytes) -> tuple[str, float | None, int | None, int | None, np.ndarray]:
    """Kind, duration, rate, channels and the mean of the channels in [-1, 1); kind None if the bytes are no PCM WAV."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            n, rate, channels, width = w.getnframes(), w.getframerate(), w.getnchannels(), w.getsampwidth()
            raw = w.readframes(n)
    except (wave.Error, EOFError):
        return None, None, None, None, np.zeros(0, np.float32)
    return "WAV", n / rate if rate else None, rate, channels, amplitudes(raw, width, channels)


def amplitudes(raw: bytes, width: int, channels: int) -> np.ndarray:
    """The mean of the channels in [-1, 1) of PCM samples of `width` bytes; a cut sample at the end goes."""
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 1 << 23) - (1 << 23)
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64) - (128 if width == 1 else 0)
    return (x.reshape(-1, channels).mean(axis=1) / float(1 << 8 * width - 1)).astype(np.float32)


def open_path(path: str):
    """A seekable file by its path or URI."""
    system, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def layout(f, size: int) -> tuple[int, int, int, int, int] | None:
    """Rate, channels, bytes a sample, where the samples begin and how many bytes they are; None if it is no PCM WAV."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    at, long_data, form = 12, None, None
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", read(at, 8))
        if kind == b"ds64":
            long_data = struct.unpack("<Q", read(at + 16, 8))[0]
        elif kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            form = (rate, channels, (bits + 7) // 8) if code in (1, 0xFFFE) and channels and 0 < bits <= 32 else None
        elif kind == b"data":
            length = long_data if length == 0xFFFFFFFF and long_data is not None else length
            return (*form, at + 8, min(length, size - at - 8)) if form else None
        at += 8 + length + length % 2
    return None


HEADER = "path string, duration double, sampling_rate int, file_type string, channels int, n_samples long, width int, data_at long"


def wav_headers(spark: SparkSession, path: str, opener: Callable = open_path) -> DataFrame:
    """file, file_name, duration, sampling_rate, file_type, channels, n_samples (of each channel), width and data_at of each file.

    file_type is null, like all that follows it, for a file that is no PCM WAV.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "length")
    names = [x.split()[0] for x in HEADER.split(", ")]
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def header(name: str, size: int) -> tuple:
        with opener(name) as f:
            found = layout(f, size)
        if found is None:
            return (name, *[None] * 7)
        rate, channels, width, at, length = found
        n = length // (width * channels)
        return name, n / rate if rate else None, rate, "WAV", channels, n, width, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [header(p.as_py(), n.as_py()) for p, n in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    rows = files.mapInArrow(run, HEADER)
    return rows.select(F.col("path").alias("file"), last_part(F.col("path"), stem=True).alias("file_name"), *names[1:])


def wav_blocks(headers: DataFrame, size: int = 1 << 16, opener: Callable = open_path) -> DataFrame:
    """file, file_name, block, first, x: the samples of the files of a header scan, `size` to a block.

    The plan is shuffled by file and block, so that one long recording is read in many tasks; a
    lost task reads its ranges again. Files without samples, or that are no PCM WAV, have no block.
    """
    plan = headers.filter("n_samples > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_samples") - 1) / size))))
    frame = F.col("width") * F.col("channels")
    plan = plan.select("file", "file_name", "block", (F.col("block") * size).alias("first"), "width", "channels", (F.col("data_at") + F.col("block") * size * frame).alias("at"), (F.least(F.col("n_samples") - F.col("block") * size, F.lit(size)) * frame).alias("bytes"))
    names = ["file", "file_name", "block", "first", "x"]

    def part(row: dict) -> pa.RecordBatch:
        with opener(row["file"]) as f:
            f.seek(row["at"])
            raw = f.read(row["bytes"])
        x = amplitudes(raw, row["width"], row["channels"])
        return pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["file_name"]]), pa.array([row["block"]], pa.int64()), pa.array([row["first"]], pa.int64()), pa.array([x], pa.list_(pa.float32()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield part(row)

    return plan.repartition("file", "block").mapInArrow(run, "file string, file_name string, block long, first long, x array<float>")


def read_wav(spark: SparkSession, path: str, samples: bool = True) -> DataFrame:
    """file, file_name (without suffix), duration, sampling_rate, file_type, channels and, if asked for, amp.

    Without samples only headers are read. With them each file is one row, so this is for short
    recordings (under Spark's 2 GB a file); `wav_blocks` reads those of any length.
    """
    names = ["duration", "sampling_rate", "file_type", "channels"]
    if not samples:
        return wav_headers(spark, path).select("file", "file_name", *names)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    names = ["path", *names, "amp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [decode(c.as_py()) for c in batch.column(1)]
                columns = [batch.column(0), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[0] for f in found], pa.string()), pa.array([f[3] for f in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[4] for f in found], pa.list_(pa.float32()))], names)

    rows = files.mapInArrow(run, "path string, duration double, sampling_rate int, file_type string, channels int, amp array<float>")
    return rows.select(F.col("path").alias("file"), last_part(F.col("path"), stem=True).alias("file_name"), *names[1:])


def missing_files(wanted: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Rows whose key has no file of that name."""
    return wanted.join(files.select(F.col("file_name").alias(key)).distinct(), key, "left_anti")
