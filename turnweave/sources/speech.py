"""Speech recognition and diarization as tables.

Models plug in as adapters: any callable that takes a path.  What they return goes through the same flattening as
stored JSON, so everything after this module is the same for live and for stored results.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .. import schemas

KEY = "recording"


class DiarizationError(RuntimeError):
    """A recording whose speakers could not be told apart."""


class Transcriber(Protocol):
    """Options: initial_prompt, verbose, word_timestamps, and language only if one was asked for."""

    def __call__(self, path: str, **options) -> dict: ...


class Diarizer(Protocol):
    def __call__(self, path: str, **options) -> dict: ...


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """recording and the nested result of one JSON file a recording."""
    rows = spark.read.schema(schemas.ASR).option("multiLine", True).json(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias(KEY), "segments")


@F.pandas_udf(ArrayType(LongType()))
def sums_before(numbers: pd.Series) -> pd.Series:
    """For each place of an array of numbers the sum of those before it."""
    return numbers.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64) - np.asarray(x, dtype=np.int64))


def flatten_words(results: DataFrame) -> DataFrame:
    """Words of (recording, segments), a row a recording, in the recogniser's order, which is not sorted by time.

    Words are numbered inside the row, by how many the segments before have, so nothing is sent or sorted.
    """
    counts = F.transform("segments", lambda s: F.coalesce(F.size(s["words"]), F.lit(0)))
    counted = results.select(KEY, "segments", sums_before(F.transform(counts, lambda n: F.greatest(n, F.lit(0)).cast("long"))).alias("_before"))
    s = counted.select(KEY, "_before", F.posexplode("segments").alias("_s", "segment"))
    w = s.select(KEY, F.get("_before", F.col("_s")).alias("_before"), F.posexplode("segment.words").alias("_w", "word"))
    return w.select(KEY, (F.col("_before") + F.col("_w")).alias("word_idx"), "word.word", "word.start", "word.end", "word.probability")


def load_diarizer(load: Callable[[str], Diarizer], token: str | None, looked_in: tuple[str, ...] = (), move: Callable[[Diarizer], None] | None = None) -> Diarizer:
    """load(token), with errors that say what to do; move, to a faster device, may fail and then only warns."""
    if not token:
        raise RuntimeError(f"no credential for the diarization model; looked in {', '.join(looked_in) or 'the environment'}. The model's terms must be accepted too")
    try:
        model = load(token)
    except Exception as problem:
        causes = "the credential is invalid or expired; the model's terms are not accepted; there is no network for the first download; the download is damaged"
        raise RuntimeError(f"the diarization model cannot be loaded. Common causes: {causes}. Underlying error ({type(problem).__name__}): {problem}") from problem
    if move is not None:
        try:
            move(model)
        except Exception as problem:  # noqa: BLE001  the model works where it is
            print(f"warning: the diarization model stays on the CPU: {problem}", file=sys.stderr)
    return model


def transcribe(files: DataFrame, make: Callable[[], Transcriber], language: str | None = "en", initial_prompt: str | None = None, verbose: bool | None = None, word_timestamps: bool = True) -> DataFrame:
    """recording, segments, error; make() runs once for each Python worker's batch stream, on the executor."""
    options = {"initial_prompt": initial_prompt, "verbose": verbose, "word_timestamps": word_timestamps} | ({} if language is None else {"language": language})

    def run(batches):
        model = make()
        for pdf in batches:
            rows = []
            for recording, path in zip(pdf[KEY], pdf.path, strict=True):
                try:
                    rows.append((recording, json.dumps({"segments": model(path, **options)["segments"]}), None))
                except Exception as problem:  # noqa: BLE001  one recording's failure is a row, not the batch's end
                    rows.append((recording, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[KEY, "json", "error"])

    raw = files.select(KEY, "path").mapInPandas(run, f"{KEY} string, json string, error string")
    return raw.select(KEY, F.from_json("json", schemas.ASR)["segments"].alias("segments"), "error")


def diarize(files: DataFrame, make: Callable[[], Diarizer], num_speakers: int | None = None) -> DataFrame:
    """recording, tracks, labels, embeddings, error; num_speakers is passed on only if given."""
    options = {} if num_speakers is None else {"num_speakers": num_speakers}
    kind = "tracks array<struct<start: double, end: double, label: string>>, labels array<string>, embeddings array<array<double>>"

    def run(batches):
        model = make()
        for pdf in batches:
            rows = []
            for recording, path in zip(pdf[KEY], pdf.path, strict=True):
                try:
                    out = model(path, **options)
                    body = {"tracks": [{"start": float(s), "end": float(e), "label": str(x)} for s, e, x in out["tracks"]], "labels": [str(x) for x in out["labels"]], "embeddings": [[float(v) for v in e] for e in out["embeddings"]]}
                    rows.append((recording, json.dumps(body), None))
                except Exception as problem:  # noqa: BLE001
                    rows.append((recording, None, f"{DiarizationError.__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[KEY, "json", "error"])

    raw = files.select(KEY, "path").mapInPandas(run, f"{KEY} string, json string, error string")
    return raw.select(KEY, F.from_json("json", kind).alias("d"), "error").select(KEY, "d.*", "error")


def diarization_turns(results: DataFrame) -> DataFrame:
    """Turns of (recording, tracks) sorted by start; equal starts keep their order."""
    t = results.select(KEY, F.posexplode("tracks").alias("_p", "t"))
    index = F.row_number().over(Window.partitionBy(KEY).orderBy("t.start", "_p")).cast("long") - 1
    return t.select(KEY, index.alias("dturn_idx"), "t.start", "t.end", F.col("t.label").cast("string").alias("speaker"))


def speaker_embeddings(results: DataFrame) -> DataFrame:
    """Row i of the embeddings belongs to label i as the diarizer lists them; labels are never sorted again."""
    rows = results.select(KEY, F.posexplode(F.arrays_zip("labels", "embeddings")).alias("label_idx", "x"))
    return rows.select(KEY, F.col("label_idx").cast("long").alias("label_idx"), F.col("x.labels").cast("string").alias("speaker"), F.col("x.embeddings").alias("embedding"))


def speaker_count_warnings(results: DataFrame, requested: int) -> DataFrame:
    found = F.size("labels")
    message = F.format_string(f"asked for {requested} speakers, found %d", found)
    return results.where(found != requested).select(KEY, F.lit("speaker_count").alias("kind"), message.alias("message"))
