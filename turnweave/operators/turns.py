"""Turns from aligned words, first-appearance labels, and smoothing of stray turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_backchannel, strip, words
from .scan import numbered_runs

KEY = "recording"
#: Words that one task numbers at a time.
RANGE_WORDS = 1 << 16


def group_consecutive(aligned: DataFrame) -> DataFrame:
    """One turn for each unbroken run of a speaker; start of the first and end of the last word by position."""
    runs = numbered_runs(aligned, F.col("speaker"), ["word_idx"], RANGE_WORDS, "turn_idx")
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "word", "probability")))
    turns = runs.groupBy(KEY, "turn_idx").agg(
        F.min_by("speaker", "word_idx").alias("speaker"),
        F.min_by("start", "word_idx").alias("start"),
        F.max_by("end", "word_idx").alias("end"),
        ordered.alias("_w"),
    )
    text = strip(F.array_join(F.transform("_w", lambda x: x["word"]), ""))
    mean = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["probability"]) / F.size("_w")
    return turns.select(KEY, "turn_idx", "speaker", "start", "end", text.alias("text"), mean.alias("confidence"))


def relabel_speakers(turns: DataFrame) -> DataFrame:
    """Person 1, Person 2 ... by first appearance; extra columns stay."""
    first = F.min("turn_idx").over(Window.partitionBy(KEY, "speaker"))
    rank = F.dense_rank().over(Window.partitionBy(KEY).orderBy("_first"))
    return turns.withColumn("_first", first).withColumn("speaker", F.concat(F.lit("Person "), rank.cast("string"))).drop("_first")


def smoothing_marks(turns: DataFrame, max_words: int = 2) -> DataFrame:
    """turns with eligible, absorbed, and kept_by: why a short turn between two of one other speaker is not eligible ("duration" or
    "word list", in this order; null for all other turns).

    A turn is eligible between two turns of one other speaker, with few words, no duration, and no acknowledgement.  Of
    neighbouring eligible turns the first absorbs the second as its follower, which is then not asked itself: so
    the odd places of a run of eligible turns are absorbed.
    """
    order = Window.partitionBy(KEY).orderBy("turn_idx")
    before, after = F.lag("speaker").over(order), F.lead("speaker").over(order)
    short = (before == after) & (before != F.col("speaker")) & (F.size(words(F.col("text"))) <= max_words)
    lasts, known = F.col("end") - F.col("start") != 0, is_backchannel(F.col("text"))
    kept_by = F.when(short & lasts, "duration").when(short & known, "word list")
    marked = turns.withColumns({"eligible": F.coalesce(short & ~lasts & ~known, F.lit(False)), "kept_by": kept_by})
    fresh = (F.col("eligible") != F.coalesce(F.lag("eligible").over(order), ~F.col("eligible"))).cast("long")
    marked = marked.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    place = F.row_number().over(Window.partitionBy(KEY, "_run").orderBy("turn_idx"))
    return marked.withColumn("absorbed", F.col("eligible") & (place % 2 == 1)).drop("_fresh", "_run")


def smooth_micro_turns(turns: DataFrame, max_words: int = 2) -> DataFrame:
    """Absorbed turns and their follower join the turn before; no word is lost."""
    order = Window.partitionBy(KEY).orderBy("turn_idx")
    marked = smoothing_marks(turns, max_words)
    opens = ~F.col("absorbed") & ~F.coalesce(F.lag("absorbed").over(order), F.lit(False))
    blocks = marked.withColumn("_open", opens.cast("long")).withColumn("_block", F.sum("_open").over(order))
    parts = F.array_sort(F.collect_list(F.struct("turn_idx", "text")))
    joined = F.array_join(F.filter(F.transform(parts, lambda x: x["text"]), lambda t: t != ""), " ")
    return blocks.groupBy(KEY, "_block").agg(
        F.min_by("speaker", "turn_idx").alias("speaker"),
        F.min_by("start", "turn_idx").alias("start"),
        F.max_by("end", "turn_idx").alias("end"),
        joined.alias("text"),
        F.min("confidence").alias("confidence"),
        F.count("*").alias("n_merged"),
    ).select(KEY, (F.col("_block") - 1).alias("turn_idx"), "speaker", "start", "end", "text", "confidence", "n_merged")


def group_into_turns(aligned: DataFrame, smooth: bool = False) -> DataFrame:
    turns = group_consecutive(aligned)
    return relabel_speakers(smooth_micro_turns(turns).drop("n_merged") if smooth else turns)
