"""Rendered transcripts: written one file a recording, and read back as blocks."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators.render import parse_blocks


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return parse_blocks(files.select(stem(F.input_file_name()).alias("recording"), F.col("value").alias("markdown")))


def write_transcripts(rendered: DataFrame, folder: str, suffix: str = ".md", allow_empty: bool = False, expected: DataFrame | None = None) -> list[str]:
    """<recording><suffix> below folder, which may lie in any of Hadoop's file systems; returns recordings without speech.

    Rows are (recording, markdown).  Tasks write one file for each recording, and the driver only renames them.  A recording
    of nothing but a line end, or one that is only in expected (recording), has no speech and gets no file, unless
    allow_empty.  Names that are no file names fail.
    """
    spark = rendered.sparkSession
    rows = rendered.select("recording", "markdown")
    if expected is not None:
        rows = expected.select("recording").distinct().join(rows, "recording", "left")
    text = F.coalesce(F.regexp_replace("markdown", r"\n$", ""), F.lit(""))
    rows = rows.select("recording", F.when(F.col("recording").rlike(r"^[^/\x00]+$"), text).otherwise(F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce("recording", F.lit("null")))).cast("string")).alias("value")).persist()
    silent = [] if allow_empty else sorted(r["recording"] for r in rows.where(F.trim("value") == "").select("recording").collect())
    written = rows if allow_empty else rows.where(F.trim("value") != "")
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(root)
    parts = path(root, f"_writing-{uuid.uuid4().hex}")
    try:
        written.write.partitionBy("recording").text(parts.toString(), lineSep="\n")
        for own in files.listStatus(parts):
            name = own.getPath().getName()
            if name.startswith("recording="):
                place = path(root, unquote(name.removeprefix("recording=")) + suffix)
                files.delete(place, False)
                for file in files.listStatus(own.getPath()):
                    files.rename(file.getPath(), place)
    finally:
        files.delete(parts, True)
        rows.unpersist()
    return silent
