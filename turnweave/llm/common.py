"""Shared plumbing of the corpus operators: tables, shared scratch, word hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of source text that one shard of a sharded stage should hold.
SHARD_BYTES = 6 << 20
#: Bytes of texts that a worker turns into Python objects at a time.
PORTION_BYTES = 4 << 20
#: Spark's settings for deleting shuffle files at the end of an execution, and for the bytes of an Arrow batch.
CLEANUP, BATCH_BYTES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about most bytes of one column, so that a worker holds few long texts as objects.

    Spark bounds a batch by bytes as well as rows (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield b.slice(start, end - start)
    hand_back()


def hand_back() -> None:
    """Return freed memory to the machine at the end of a task: Spark keeps its Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that all machines share (spark.checkpoint.dir).

    Only where that setting is absent and everything runs in this one process, as in local tests, a temporary folder of
    this machine is used; elsewhere that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/turnweave-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession, batch_bytes: int = 8 << 20) -> Iterator[None]:
    """Settings of a write, taken back after it: shuffle files go as soon as it is done, Arrow batches are of batch_bytes."""
    settings = {CLEANUP: "true", BATCH_BYTES: str(batch_bytes)}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, compression: str = "zstd", batch_bytes: int = 8 << 20) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with writing(spark, batch_bytes):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            parent = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if parent.getName().startswith("turnweave-"):
                parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


def least_hashes(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """The rows of df with the smallest values of the long hash h: about twice as many as asked for, or all if there are few.

    Only a count of df is needed to choose them, so little is moved however large df is; whoever needs exactly rows sorts.
    """
    n = df.count()
    return df if n <= 2 * rows else df.where(h < -(1 << 63) + (2 * rows << 64) // n)


def shard_count(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards of about shard_bytes the text column needs; one narrow scan."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // shard_bytes))


# -- words -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
#: Value of every byte in a word's polynomial; 0 for the separators of the word pattern [^\x20\x09-\x0D]+.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes hashed at a time, and the powers of the base and of its inverse modulo 2**64 up to there.
_SPAN = 1 << 18
_SEPARATORS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(_SPAN, base, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x))
    return _POWERS


def _long_text(data: bytes):
    """Hashes of the words of data, in parts that end at separators; a word of _SPAN bytes or more is a part of its own."""
    start = 0
    while len(data) - start >= _SPAN:
        part = data[start : start + _SPAN]
        cut = max(part.rfind(c) for c in _SEPARATORS) + 1
        if cut:
            yield hashed_words(part[: cut - 1])
            start += cut
        else:
            end = min((e for e in (data.find(c, start) for c in _SEPARATORS) if e >= 0), default=len(data))
            yield np.array([int.from_bytes(hashlib.blake2b(data[start:end], digest_size=8).digest(), "little")], dtype=np.uint64)
            start = end
    yield hashed_words(data[start:])


def hashed_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of data, in order, without a Python loop over words.

    The polynomial of a word is the difference of two running sums, moved to the word's start.  Long texts are cut at
    separators; a single word longer than a cut is hashed by itself.
    """
    if len(data) >= _SPAN:
        return np.concatenate(list(_long_text(data)) or [np.empty(0, dtype=np.uint64)])
    value = _VALUE[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(value) + 2, dtype=bool)
    inside[1:-1] = value != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers()
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value * power[: len(value)], out=total[1:])
    starts, ends = edges[::2], edges[1::2]
    return mix((total[ends] - total[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of size consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(1000 * seed)) | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += words[j : j + n] * factors[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

