"""Markdown out of turns, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stamp, strip

KEY = "recording"


def block(turn_speaker="speaker", start="start", text="text"):
    return F.concat(F.lit("## "), F.col(turn_speaker), F.lit(" — "), stamp(F.col(start)), F.lit("\n\n"), F.col(text), F.lit("\n"))


def render_markdown(turns: DataFrame) -> DataFrame:
    """recording, markdown: all blocks of a recording in order, one line end at the end."""
    blocks = F.array_sort(F.collect_list(F.struct("turn_idx", block().alias("block"))))
    joined = F.array_join(F.transform(blocks, lambda x: x["block"]), "\n")
    return turns.groupBy(KEY).agg(joined.alias("_m")).select(KEY, F.concat(F.regexp_replace("_m", r"(?U)[\s\x1c-\x1f\x85]+$", ""), F.lit("\n")).alias("markdown"))


def parse_blocks(documents: DataFrame) -> DataFrame:
    """recording, block_idx, speaker, stamp, text of rendered Markdown (recording, markdown)."""
    pattern = r"(?ms)^## (Person \d+) — ([\d:]+)\n\n(.*?)(?=\n## |\z)"
    found = F.arrays_zip(*[F.regexp_extract_all("markdown", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "speaker"), (2, "stamp"), (3, "text"))])
    rows = documents.select(KEY, F.posexplode(found).alias("block_idx", "b"))
    return rows.select(KEY, F.col("block_idx").cast("long").alias("block_idx"), F.col("b.speaker").alias("speaker"), F.col("b.stamp").alias("stamp"), strip(F.col("b.text")).alias("text"))
