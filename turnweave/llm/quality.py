"""Operator 9: quality from compressed sizes.

Two zstandard dictionaries are built from good and bad labelled texts.  A whole text is cut into pieces of PIECE bytes, so
that a long text does not come to resemble itself, and every piece is compressed with either dictionary; the difference
of the two total sizes, divided by the bytes of the text, says which kind it resembles.  A logistic curve over this one
number, fitted on labelled texts that did not go into the dictionaries, turns it into a probability.

The fit reads at most FIT_ROWS labelled rows of the training fold, the ones with the smallest hash of their doc_id; of each
text at most FIT_CHARS characters, spread over the whole of it, go into a dictionary, while the curve is fitted on whole
texts, measured where they lie.  Scores are given to every row.  Labels, language, source and doc_id never enter a score.

Defined results: a null or empty text has no difference and gets what the curve gives for that; null labels, and ids with
labels that contradict one another, are not learnt from; of a labelled id with several texts the least text is learnt from;
repeated rows get equal scores; with no labels, or only one class, every score is 0.5.  An empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, least_hashes, materialize, portions, table

FIT_ROWS, FIT_CHARS, DICT_BYTES, LEVEL, PIECE = 4000, 8192, 112_640, 3, 512
#: Places that a long text is sampled at.
PLACES = 8
THRESHOLD = 0.3


def fold(doc_id: F.Column, modulus: int) -> F.Column:
    """crc32 of the decimal doc_id, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and y of at most rows labelled documents, chosen by a hash of doc_id, so the same at every partitioning."""
    spark = docs.sparkSession
    h = F.xxhash64("doc_id")
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    near = least_hashes(marked, h, rows).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    chosen = sorted((r["h"], r["doc_id"], r["y"]) for r in near.select(h.alias("h"), "doc_id", "y").collect())[:rows]
    wanted = spark.createDataFrame([(d, y) for _, d, y in chosen], "doc_id long, y int")
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id").where("text <> ''")
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))


def excerpts(sample: DataFrame, chars: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, y) in order of doc_id; of texts over chars characters, PLACES parts spread over the whole text."""
    n, part = F.char_length("text"), chars // PLACES
    spread = F.concat(*[F.col("text").substr((n * i / PLACES).cast("int") + 1, F.lit(part)) for i in range(PLACES)])
    return sorted((r["doc_id"], r["t"], r["y"]) for r in sample.select("doc_id", F.when(n <= chars, F.col("text")).otherwise(spread).alias("t"), "y").collect())


def measured(sample: DataFrame, model, width: int) -> tuple[np.ndarray, np.ndarray]:
    """model.inputs() of the whole texts of a bounded sample, measured on the executors, and y."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in portions(batches):
            x = [m.inputs(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in sample.mapInArrow(run, "doc_id long, y int, x array<double>").collect())
    return np.array([x for _, _, x in rows], dtype=float).reshape(-1, width), np.array([y for _, y, _ in rows], dtype=float)


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.weight, self.bias = 0.0, 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def inputs(self, text: str) -> np.ndarray:
        """How many bytes fewer the good dictionary needs than the bad one, for each byte of the text."""
        if not hasattr(self, "_packers"):
            kinds = [zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in kinds]
        raw = text.encode()
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        g, b = (sum(len(p.compress(x)) for x in pieces) for p in self._packers)
        return np.array([(b - g) / (len(raw) + 64)])

    def score(self, text: str | None) -> float:
        z = self.weight * float(self.inputs(text or "")[0]) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method for a ridge logistic curve."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; for too few samples the plain tail of their bytes."""
    size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def train_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> CompressionModel:
    """Half of the sampled rows build the dictionaries, the other half the curve."""
    sample = labelled_sample(docs, labels, "quality", fit_rows)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    known = excerpts(sample.where(half == 0), FIT_CHARS)
    good, bad = ([t.encode() for _, t, y in known if y == k] for k in (1, 0))
    model = CompressionModel(b"", b"")
    if good and bad:
        trial = CompressionModel(dictionary(good), dictionary(bad))
        x, y = measured(sample.where(half == 1), trial, 1)
        if len(set(y.tolist())) == 2:
            scale = x.std() + 1e-9
            weights, bias = fit_logistic(x / scale, y, ridge=1e-3)
            trial.weight, trial.bias = float(weights[0] / scale), bias
            model = trial
    forget(sample)
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row; model.score(text) gives 0 to 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())], schema=SCORES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
