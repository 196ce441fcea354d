"""Words to speakers: the turn of greatest overlap, else the turn with the nearest edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_seconds
from .spans import AT, met_first, on_cells

KEY = "recording"


def overlapping(words: DataFrame, turns: DataFrame, cell_seconds: float = 30.0) -> DataFrame:
    """word_idx, dturn_idx, speaker and overlap of all pairs that overlap.

    Both sides stand on time cells of several sizes; the join is an equi-join on (recording, size, cell), and a pair counts only
    in the cell where its common part begins, so no pair is met twice.
    """
    w = words.where("end > start").select(KEY, "word_idx", F.col("start").alias("ws"), F.col("end").alias("we"))
    t = turns.where("end > start").select(KEY, "dturn_idx", "speaker", F.col("start").alias("ts"), F.col("end").alias("te"))
    met = on_cells(w, t, "ws", "we", "_ww", cell_seconds, "ts", "te").join(on_cells(t, w, "ts", "te", "_tt", cell_seconds, "ws", "we"), [KEY, *AT])
    pairs = met.where((F.col("ws") < F.col("te")) & (F.col("ts") < F.col("we")) & met_first("_ww", "_tt", F.greatest("ws", "ts"), cell_seconds))
    return pairs.select(KEY, "word_idx", "dturn_idx", "speaker", overlap_seconds(F.col("ws"), F.col("we"), F.col("ts"), F.col("te")).alias("overlap"))


def align_overlap(words: DataFrame, turns: DataFrame) -> DataFrame:
    """recording, word_idx, speaker of words with some overlap; of equal overlaps the first turn wins."""
    best = F.max_by("speaker", F.struct(F.col("overlap"), -F.col("dturn_idx")))
    return overlapping(words, turns).where("overlap > 0").groupBy(KEY, "word_idx").agg(best.alias("speaker"))


def align_nearest(words: DataFrame, turns: DataFrame, cell_seconds: float = 30.0) -> DataFrame:
    """recording, word_idx, speaker by the nearest edge: turn ends against the word's start, turn starts against its end.

    An as-of join by time cells: an edge of a word meets the turns' edges in its own cell, the last one before the cell and
    the first one after it.  Those two are carried over cells without edges, so no window looks further than one row; a word
    beyond all edges takes the cell next to them.
    """
    sides = lambda ends, starts: F.explode(F.array(F.struct(F.lit("end").alias("kind"), F.col(ends).alias("t")), F.struct(F.lit("start").alias("kind"), F.col(starts).alias("t")))).alias("s")
    cell = F.floor(F.col("t") / cell_seconds)
    own = [KEY, "kind", "cell"]
    edges = turns.select(KEY, sides("end", "start"), F.struct("dturn_idx", "speaker").alias("x")).groupBy(KEY, "s.kind", "s.t").agg(F.min("x").alias("x"))
    edges = edges.select(KEY, "kind", cell.alias("cell"), F.struct(F.col("t").alias("at"), "x.dturn_idx", "x.speaker").alias("edge"))
    order = Window.partitionBy(KEY, "kind").orderBy("cell")
    used = edges.groupBy(*own).agg(F.min("edge").alias("first"), F.max("edge").alias("last"))
    used = used.select("*", F.lag(F.struct("cell", "last")).over(order).alias("before"), F.lead("first").over(order).alias("after"))
    # a used cell, and the cells without edges between it and the used one before
    upto = used.select(KEY, "kind", F.explode(F.sequence(F.coalesce(F.col("before.cell") + 1, F.col("cell") - 1), "cell")).alias("at"), "cell", "first", F.col("before.last").alias("before"), "after")
    upto = upto.select(KEY, "kind", F.col("at").alias("cell"), "before", F.when(F.col("at") < F.col("cell"), F.col("first")).otherwise(F.col("after")).alias("after"))
    beyond = used.where("after is null").select(KEY, "kind", (F.col("cell") + 1).alias("cell"), F.col("last").alias("before"), "after")
    carried = upto.unionByName(beyond).select(*own, F.explode(F.array_compact(F.array("before", "after"))).alias("edge"))
    bounds = used.groupBy(KEY, "kind").agg((F.min("cell") - 1).alias("lo"), (F.max("cell") + 1).alias("hi"))
    asked = words.select(KEY, "word_idx", sides("start", "end")).select(KEY, "word_idx", "s.kind", "s.t").join(bounds, [KEY, "kind"])
    asked = asked.select(KEY, "kind", F.greatest("lo", F.least("hi", cell)).alias("cell"), "word_idx", "t")
    met = asked.join(edges.unionByName(carried), own)
    ranked = F.struct(F.abs(F.col("t") - F.col("edge.at")).alias("distance"), "edge.dturn_idx", "edge.speaker")
    return met.groupBy(KEY, "word_idx").agg(F.min(ranked).alias("best")).select(KEY, "word_idx", "best.speaker")


def align_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every word with its speaker.  A recording with words but without turns is an error.

    Words of no duration overlap nothing and always go by the nearest edge.
    """
    with_overlap = align_overlap(words, turns)
    rest = words.join(with_overlap, [KEY, "word_idx"], "left_anti")
    found = with_overlap.unionByName(align_nearest(rest, turns))
    out = words.join(found, [KEY, "word_idx"], "left")
    checked = F.when(F.col("speaker").isNull(), F.raise_error(F.concat(F.lit("no speaker turns to align with in "), F.col(KEY).cast("string")))).otherwise(F.col("speaker"))
    return out.withColumn("speaker", checked)
