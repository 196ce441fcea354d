"""WAV files in byte ranges: one recording is read by as many tasks as it has ranges.

Rows are (recording, rate, start, samples): CHUNK_WINDOWS windows of samples of the first channel, with the index of the first,
so a row's size does not grow with the recording.  A range is RANGE_WINDOWS windows, so no window lies in two ranges.

* spark.read.format("wav").load(path) after register(): a file or a folder of files.
* read_ranges(files): the files that a table names, with the table's other columns; headers are read by tasks too.
* read_wav(spark, path): as the first, and for paths that only Spark opens (another file system) by Spark's own reader of
  whole files, which gives a file to one task.

The first two open files in tasks: their folder must be mounted on all machines.
"""

from __future__ import annotations

import glob
import io
import os
import re
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import stem
from ..operators.offset import WINDOW_SECONDS

CHUNK_WINDOWS, RANGE_WINDOWS = 300, 12_000
CHUNKS = "rate int, start long, samples array<int>"


def ranges_of(file) -> list[tuple[int, int]]:
    """(first, past the last) sample of the ranges of an open file, path or stream."""
    with wave.open(file, "rb") as f:
        step, n = RANGE_WINDOWS * max(1, int(f.getframerate() * WINDOW_SECONDS)), f.getnframes()
    return [(k, min(k + step, n)) for k in range(0, max(n, 1), step)]


def chunks_of(file, name: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(rate, start, samples) of the chunks between two samples; only their bytes are read."""
    with wave.open(file, "rb") as f:
        if f.getsampwidth() != 2:
            raise ValueError(f"{name}: only 16-bit samples are read")
        rate, last = f.getframerate(), f.getnframes() if last is None else last
        f.setpos(min(first, f.getnframes()))
        step = CHUNK_WINDOWS * max(1, int(rate * WINDOW_SECONDS))
        while first < last and (frames := f.readframes(min(step, last - first))):
            samples = np.frombuffer(frames, dtype="<i2").reshape(-1, f.getnchannels())[:, 0]
            yield rate, first, samples
            first += len(samples)


def local(path: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", path)


class WavPartition(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class WavReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = local(path)

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.wav"))) if os.path.isdir(self.path) else [self.path]
        return [WavPartition(f, *r) for f in files for r in ranges_of(f)]

    def read(self, partition):
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for rate, start, samples in chunks_of(partition.path, partition.path, partition.first, partition.last):
            yield name, rate, start, samples.tolist()


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return f"recording string, {CHUNKS}"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavDataSource)


def _as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_ranges(files: DataFrame, path: str = "path") -> DataFrame:
    """The other columns of files, and rate, start, samples of the WAV file that path names; each range may be another task's.

    A file that cannot be read fails the job with its name; rows with a null path give no rows.
    """
    keep = [c for c in files.columns if c != path]

    def cut(batches):
        for b in batches:
            rows = [(p, *r) for p in b.column("_path").to_pylist() if p for r in ranges_of(local(p))]
            yield _as_batch(rows, ["_path", "_first", "_last"], [pa.string(), pa.int64(), pa.int64()])

    def read(batches):
        for b in batches:
            for p, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for rate, start, samples in chunks_of(local(p), p, first, last):
                    yield _as_batch([(p, rate, start, samples)], ["_path", "rate", "start", "samples"], [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32())])

    named = files.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    ranges = named.mapInArrow(cut, "_path string, _first long, _last long").repartition("_path", "_first")
    found = ranges.mapInArrow(read, f"_path string, {CHUNKS}")
    return files.withColumnRenamed(path, "_path").join(found, "_path").select(*keep, "rate", "start", "samples")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """recording, rate, start, samples of a file or folder in any file system that Spark reads."""
    if os.path.exists(local(path)):
        register(spark)
        return spark.read.format("wav").load(path)

    def read(batches):
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for rate, start, samples in chunks_of(io.BytesIO(content), p):
                    yield _as_batch([(p, rate, start, samples)], ["_path", "rate", "start", "samples"], [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32())])

    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".wav")).select("path", "content")
    return files.mapInArrow(read, f"_path string, {CHUNKS}").select(stem(F.col("_path")).alias("recording"), "rate", "start", "samples")


def write_wav(path: str, samples, rate: int = 16000) -> None:
    """A peak-normalised (half scale) 16-bit file; for tests."""
    x = np.asarray(samples, dtype=float)
    peak = np.abs(x).max() if len(x) else 0.0
    with wave.open(path, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((x * (0.5 * 32767 / peak if peak else 0.0)).astype("<i2").tobytes())
