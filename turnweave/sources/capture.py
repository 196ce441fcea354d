"""Captures: all intermediate tables of a fusion as a folder of Parquet tables, to render and measure again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("words_a", "words_b", "diarization_a", "diarization_b", "embeddings_a", "embeddings_b", "turns_a", "turns_b", "offsets")


def write_capture(folder: str, tables: dict[str, DataFrame]) -> None:
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"not tables of a capture: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def capture_folder(folder: str | None = None) -> str:
    """The capture's folder: as given, else from TURNWEAVE_CAPTURE; says how to make one if there is none."""
    folder = folder or os.environ.get("TURNWEAVE_CAPTURE")
    if not folder or ("://" not in folder and not os.path.isdir(folder)):
        raise FileNotFoundError(f"no capture at {folder!r}: write one with --fuse ... --capture FOLDER (write_capture()), or set TURNWEAVE_CAPTURE to its folder")
    return folder


def read_capture(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    folder = capture_folder(folder)
    out = {}
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out
