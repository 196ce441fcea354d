"""Fusion of two versions of one conversation: replace, guard, fill gaps, order.

Turns are rows (recording, turn_idx, speaker, start, end, text, confidence); recording names the meeting, and b is
already on a's clock and labels.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment_text, gap_seconds, overlap_seconds
from .spans import AT, met_first, on_cells

KEY = "recording"
RADIUS, MIN_CHARS, MAX_GAP, COVERED = 2, 20, 15.0, 0.5


def shift_and_remap(turns: DataFrame, offsets: DataFrame, mapping: DataFrame) -> DataFrame:
    """b's turns on a's clock and under a's labels.

    offsets (recording, offset_s), mapping (recording, speaker, to_speaker), both a few rows a meeting.  What ends at
    or before zero goes; what straddles zero starts at zero with its whole text.  A recording without an offset fails, as
    does a speaker that the map lacks.
    """
    t = turns.join(offsets.select(KEY, "offset_s"), KEY, "left").join(mapping, [KEY, "speaker"], "left")
    t = t.withColumn("offset_s", F.when(F.col("offset_s").isNull(), F.raise_error(F.concat(F.lit("no offset for "), F.col(KEY).cast("string"))).cast("double")).otherwise(F.col("offset_s")))
    moved = t.withColumn("start", F.col("start") + F.col("offset_s")).withColumn("end", F.col("end") + F.col("offset_s")).where("end > 0")
    label = F.when(F.col("to_speaker").isNull(), F.raise_error(F.concat(F.lit("no match for speaker "), F.col("speaker")))).otherwise(F.col("to_speaker"))
    return moved.withColumn("start", F.greatest("start", F.lit(0.0))).withColumn("speaker", label).select(*turns.columns)


def same_speaker_overlaps(a: DataFrame, b: DataFrame, cell_seconds: float = 60.0) -> DataFrame:
    """recording, a_idx, b_idx, overlap and the columns both sides are compared by.

    An equi-join on (recording, speaker, time cell), with cells of several sizes: a pair counts only in the cell where its common
    part begins, so turns that are far apart never meet and no pair is met twice.
    """
    side = lambda t, k: t.where("end > start").select(KEY, "speaker", F.col("turn_idx").alias(f"{k}_idx"), F.col("start").alias(f"{k}_start"), F.col("end").alias(f"{k}_end"), F.col("confidence").alias(f"{k}_conf"))
    a, b = side(a, "a"), side(b, "b")
    met = on_cells(a, b, "a_start", "a_end", "_a", cell_seconds, "b_start", "b_end").join(on_cells(b, a, "b_start", "b_end", "_b", cell_seconds, "a_start", "a_end"), [KEY, "speaker", *AT])
    met = met.withColumn("overlap", overlap_seconds(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return met.where((F.col("overlap") > 0) & met_first("_a", "_b", F.greatest("a_start", "b_start"), cell_seconds)).drop("_a", "_b", *AT)


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording, speaker, island, rows: a's turns in order with the surer b turns that overlap them, surest first.

    An island is a maximal stretch of time that turns with candidates and their candidates cover without a break.  Turns that share
    a candidate lie on one island, so islands do not know of one another and none is longer than unbroken talk.
    """
    edges = same_speaker_overlaps(a, b).where("b_conf > a_conf")
    ranked = edges.groupBy(KEY, "speaker", "a_idx").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("b_conf")).alias("order"), F.col("b_idx")))).alias("c"),
        F.min(F.least("a_start", "b_start")).alias("lo"),
        F.max(F.greatest("a_end", "b_end")).alias("hi"),
    )
    order = Window.partitionBy(KEY, "speaker").orderBy("lo", "a_idx")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("_new", F.coalesce((reached <= F.col("lo")).cast("long"), F.lit(0))).withColumn("island", F.sum("_new").over(order))
    rows = F.array_sort(F.collect_list(F.struct("a_idx", F.transform("c", lambda x: x["b_idx"]).alias("b"))))
    return ranked.groupBy(KEY, "speaker", "island").agg(rows.alias("rows"))


def replacements(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording, a_idx, b_idx: a's turns in order each take the surest free b turn that overlaps and is surer than they are.

    A b turn that is not surer than a can never replace it, so only surer ones are listed; the fold then takes the
    first free one, for each island by itself, and remembers those taken as a set.
    """
    lists = candidates(a, b)

    def fold(batches):
        for batch in batches:
            out: list[tuple] = []
            for recording, rows in zip(batch.column(KEY).to_pylist(), batch.column("rows").to_pylist(), strict=True):
                taken: set[int] = set()
                for row in rows:
                    pick = next((i for i in row["b"] if i not in taken), None)
                    if pick is not None:
                        taken.add(pick)
                        out.append((recording, row["a_idx"], pick))
            columns = zip(*out, strict=True) if out else ((), (), ())
            kinds = (batch.schema.field(KEY).type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[KEY, "a_idx", "b_idx"])

    return lists.select(KEY, "rows").mapInArrow(fold, f"{KEY} {dict(a.dtypes)[KEY]}, a_idx long, b_idx long")


def contained_neighbours(a: DataFrame, b: DataFrame, picks: DataFrame, radius: int = RADIUS, max_gap: float | None = MAX_GAP) -> DataFrame:
    """Turns of a near a replaced turn, not replaced themselves, that overlap the b turn that replaced it, are at most max_gap
    seconds away from the replaced one, and whose normalised text is part of b's: turn_idx, speaker and chars (the length of that
    text), with a_idx, step and sp (the speaker) of the replaced turn.

    Neighbours meet by their spans alone; texts are sent to those that overlap, and only theirs are normalised.  chars is of both
    texts, so that a filter on it is not made of all of a before that.
    """
    spans = lambda t, *names: t.select(KEY, *[F.col(c).alias(n) for c, n in zip(("turn_idx", "speaker", "start", "end"), names, strict=True) if n])
    replaced = picks.join(spans(a, "a_idx", "sp", "i_start", "i_end"), [KEY, "a_idx"])
    near = replaced.join(spans(b, "b_idx", None, "b_start", "b_end"), [KEY, "b_idx"]).withColumn("step", F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])))
    near = near.withColumn("turn_idx", F.col("a_idx") + F.col("step"))
    siblings = a.select(KEY, "turn_idx", "speaker", "start", "end").join(picks.select(KEY, F.col("a_idx").alias("turn_idx")), [KEY, "turn_idx"], "left_anti")
    met = near.join(siblings, [KEY, "turn_idx"]).where(overlap_seconds(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")) > 0)
    if max_gap is not None:
        met = met.where(gap_seconds(F.col("i_start"), F.col("i_end"), F.col("start"), F.col("end")) <= max_gap)
    met = met.join(a.select(KEY, "turn_idx", F.col("text").alias("a_text")), [KEY, "turn_idx"]).join(b.select(KEY, F.col("turn_idx").alias("b_idx"), F.col("text").alias("b_text")), [KEY, "b_idx"])
    a_norm, b_norm = (containment_text(F.col(f"{k}_text")) for k in "ab")
    return met.withColumn("chars", F.when(F.contains(b_norm, a_norm), F.length(a_norm))).where("chars is not null").drop("a_text", "b_text")


def consumed_siblings(a: DataFrame, b: DataFrame, picks: DataFrame, radius: int = RADIUS, min_chars: int = MIN_CHARS, max_gap: float | None = MAX_GAP) -> DataFrame:
    """recording, turn_idx of a's turns whose words a replacing b turn already holds.

    A sibling is a contained neighbour of the replaced turn's speaker with at least min_chars characters.
    """
    near = contained_neighbours(a, b, picks, radius, max_gap)
    return near.where((F.col("speaker") == F.col("sp")) & (F.col("chars") >= min_chars)).select(KEY, "turn_idx").distinct()


def gap_filling(a: DataFrame, b: DataFrame, covered: float = COVERED) -> DataFrame:
    """b's turns of which a's turns of that speaker, all as they were, cover less than the share covered.

    Covered seconds are summed, so overlapping a turns may count twice; a b turn of no duration is never covered.
    """
    sums = same_speaker_overlaps(a, b).groupBy(KEY, F.col("b_idx").alias("turn_idx")).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("a_idx", "overlap"))), F.lit(0.0), lambda s, x: s + x["overlap"]).alias("_sum")
    )
    total = F.coalesce("_sum", F.lit(0.0))
    length = F.col("end") - F.col("start")
    share = F.when(length > 0, total / length).otherwise(F.when(total > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return b.join(sums, [KEY, "turn_idx"], "left").where(share < covered).select(*b.columns)


def merge_turns(a: DataFrame, b: DataFrame, *, containment_min_chars: int = MIN_CHARS, containment_radius: int = RADIUS, containment_max_gap: float | None = MAX_GAP, covered: float = COVERED, dedupe_winners: bool = False) -> DataFrame:
    """The fused turns, with _origin (a_kept, a_replaced, b_gapfill) and _a_idx / _b_idx.

    A b turn that replaced an a turn and is little covered by a also fills the gap, and so appears twice; dedupe_winners
    leaves the second out.
    """
    picks = replacements(a, b)
    consumed = consumed_siblings(a, b, picks, containment_radius, containment_min_chars, containment_max_gap)
    taken = picks.join(b.select(KEY, F.col("turn_idx").alias("b_idx"), *[F.col(c).alias(f"_{c}") for c in ("start", "end", "text", "confidence")]), [KEY, "b_idx"])
    kept = a.join(consumed, [KEY, "turn_idx"], "left_anti").join(taken.withColumnRenamed("a_idx", "turn_idx"), [KEY, "turn_idx"], "left")
    origin = F.when(F.col("b_idx").isNull(), F.lit("a_kept")).otherwise(F.lit("a_replaced"))
    use = lambda c: F.when(F.col("b_idx").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    from_a = kept.select(KEY, "speaker", use("start"), use("end"), use("text"), use("confidence"), origin.alias("_origin"), F.col("turn_idx").alias("_a_idx"), F.col("b_idx").alias("_b_idx"), F.lit(0).alias("_side"), F.col("turn_idx").alias("_at"))
    fill = gap_filling(a, b, covered)
    if dedupe_winners:
        fill = fill.join(picks.select(KEY, F.col("b_idx").alias("turn_idx")), [KEY, "turn_idx"], "left_anti")
    from_b = fill.select(KEY, "speaker", "start", "end", "text", "confidence", F.lit("b_gapfill").alias("_origin"), F.lit(None).cast("long").alias("_a_idx"), F.col("turn_idx").alias("_b_idx"), F.lit(1).alias("_side"), F.col("turn_idx").alias("_at"))
    order = Window.partitionBy(KEY).orderBy("start", "_side", "_at")
    return from_a.unionByName(from_b).withColumn("turn_idx", F.row_number().over(order).cast("long") - 1).drop("_side", "_at")
