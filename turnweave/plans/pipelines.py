"""From words and diarization to transcripts: one recording at a time, or two of one meeting fused.

Every function works on all recordings of its tables at once; recordings are the partitions' key.  What several later steps
read is written to the shared folder first, so alignment and merge run once; close() of the result deletes these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.align import align_words
from ..operators.duplicates import cross_speaker_duplicates
from ..operators.loops import repetition_loops
from ..operators.match import inverted, match_speakers
from ..operators.merge import merge_turns, shift_and_remap
from ..operators.offset import cross_correlation, offsets, rms_envelope_chunked
from ..operators.render import render_markdown
from ..operators.turns import group_consecutive, group_into_turns, relabel_speakers, smooth_micro_turns
from ..sources import media, speech, wav
from ..sources.scratch import Scratch

KEY = "recording"
#: A floor of characters that no text reaches.
NO_GUARD = 1_000_000_000


@dataclass
class Transcript:
    turns: DataFrame
    markdown: DataFrame
    diagnostics: DataFrame
    offsets: DataFrame | None = None
    scratch: Scratch | None = None
    #: What a fusion knows besides: turns of both sides on their own clocks, and the offsets used; a capture keeps them.
    steps: dict[str, DataFrame] = field(default_factory=dict)

    def close(self) -> None:
        """Delete the intermediate tables; the frames cannot be read after that."""
        if self.scratch is not None:
            self.scratch.close()


def loop_warnings(turns: DataFrame) -> DataFrame:
    found = repetition_loops(turns)
    said = F.format_string("'%s' is repeated %d times; the words there may be missing", "token", "count")
    return found.select(KEY, F.lit("repetition_loop").alias("kind"), F.lit("warning").alias("severity"), said.alias("message"), "start")


def duplicate_warnings(turns: DataFrame) -> DataFrame:
    found = cross_speaker_duplicates(turns)
    said = F.format_string("%s and %s share %d characters", "first_speaker", "second_speaker", "shared_chars")
    return found.select(KEY, F.lit("cross_speaker_duplicate").alias("kind"), F.lit("warning").alias("severity"), said.alias("message"), "start")


def offset_notes(found: DataFrame) -> DataFrame:
    bad = F.col("error").isNotNull()
    severity = F.when(bad, F.lit("error")).when(F.col("weak"), F.lit("warning")).otherwise(F.lit("info"))
    said = F.when(bad, F.col("error")).otherwise(F.format_string("offset %+.1f s, confidence %.2f", "offset_s", "confidence"))
    return found.select(F.col("pair_id").alias(KEY), F.lit("offset").alias("kind"), severity.alias("severity"), said.alias("message"), F.lit(None).cast("double").alias("start"))


def shown(diagnostics: DataFrame, k: int = 10) -> list[str]:
    """Lines for a console: of every kind the first k messages by start, and how many more there are; warnings never stop a run."""
    order = Window.partitionBy("kind").orderBy("start", KEY, "message")
    counts = {r["kind"]: r["n"] for r in diagnostics.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    rows = diagnostics.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).orderBy("kind", "_place").collect()
    lines = []
    for kind in dict.fromkeys(r["kind"] for r in rows):
        lines += [f"{r['severity']}: {r[KEY]}: {r['message']}" for r in rows if r["kind"] == kind]
        if counts[kind] > k:
            lines.append(f"  ... and {counts[kind] - k} more")
    return lines


def transcribe_recordings(words: DataFrame, diarization: DataFrame, smooth: bool = False) -> Transcript:
    """align, group, smooth if asked, relabel, render."""
    scratch = Scratch(words.sparkSession)
    turns = scratch.settle(group_into_turns(align_words(words, diarization), smooth))
    return Transcript(turns, render_markdown(turns), loop_warnings(turns), None, scratch)


def envelopes(sounds: DataFrame, window_seconds: float = 0.1) -> DataFrame:
    """Envelope rows of sounds (recording, side, rate, samples); sides of unequal rate fail."""
    rates = sounds.groupBy(KEY).agg(F.count_distinct("rate").alias("n"))
    checked = sounds.join(rates, KEY).withColumn("rate", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("sample rates differ in "), F.col(KEY))).cast("int")).otherwise(F.col("rate")))
    keyed = checked.withColumn(KEY, F.concat_ws("\u0001", KEY, "side"))
    e = rms_envelope_chunked(keyed, window_seconds)
    parts = F.split(F.col(KEY), "\u0001")
    return e.select(parts[0].alias("pair_id"), parts[1].alias("side"), "win_idx", "rms")


def fuse(tables: dict[str, DataFrame], envelope_rows: DataFrame, smooth: bool = False, **merge_options) -> Transcript:
    """Fusion of many meetings at once: tables words_*, diarization_*, embeddings_* of sides a and b.

    Each side is aligned and grouped, b goes onto a's clock and labels, then merge, smooth if asked, relabel, and the
    warnings look at the relabelled turns.
    """
    scratch = Scratch(envelope_rows.sparkSession)
    found = offsets(scratch.settle(cross_correlation(envelope_rows)))
    silent = tables["words_a"].select(F.col(KEY).alias("pair_id")).distinct().join(found, "pair_id", "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c not in ("pair_id", "error")]
    found = scratch.settle(found.unionByName(silent.select("pair_id", *none, F.lit("no sound to find the offset from").alias("error"))))
    usable = found.where("error is null").select(F.col("pair_id").alias(KEY), "offset_s")
    # a meeting without an offset is reported and left out, and does not stop the others
    t = {name: df.join(usable.select(KEY), KEY, "left_semi") for name, df in tables.items() if KEY in df.columns}
    side = {s: scratch.settle(group_consecutive(align_words(t[f"words_{s}"], t[f"diarization_{s}"]))) for s in "ab"}
    names = inverted(match_speakers(t["embeddings_a"], t["embeddings_b"], KEY))
    merged = merge_turns(side["a"], scratch.settle(shift_and_remap(side["b"], usable, names)), **merge_options)
    if smooth:
        merged = smooth_micro_turns(merged).drop("n_merged")
    turns = scratch.settle(relabel_speakers(merged))  # read by the rendering and by each kind of warning
    notes = offset_notes(found).unionByName(loop_warnings(turns)).unionByName(duplicate_warnings(turns))
    return Transcript(turns, render_markdown(turns), notes, found, scratch, {"turns_a": side["a"], "turns_b": side["b"], "offsets": usable})


def hear_both_sides(pairs: DataFrame, recogniser: Callable, diarizer: Callable, folder: str, scratch: Scratch, filters: str | None = None, language: str | None = "en", prompt: str | None = None, verbose: bool | None = None, num_speakers: int | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables of fuse(), envelope rows, and (recording, error), of pairs (recording, a, b) of media paths.

    Both sides of all meetings go through one extraction, one recognition and one diarization, each run once and written to
    the shared folder; the extracted files are read by byte ranges.  A side that fails takes its meeting out, and is named.
    """
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("path")) for s in "ab"])).alias("x")
    sides = pairs.select(KEY, both).select(KEY, "x.side", "x.path")
    clean = scratch.settle(media.extract_audio(sides.select("path").distinct(), folder, filters).join(sides, "path").select(KEY, "side", "path", "cleaned", "error"))
    # models know a side as a recording of its own
    ready = clean.where("error is null").select(F.concat_ws("\u0001", KEY, "side").alias(KEY), F.col("cleaned").alias("path"))
    part = lambda k: F.split(F.col(KEY), "\u0001")[k]
    apart = lambda df: scratch.settle(df.withColumn("side", part(1)).withColumn(KEY, part(0)))
    heard = apart(speech.transcribe(ready, recogniser, language, prompt, verbose))
    found = apart(speech.diarize(ready, diarizer, num_speakers))
    named = lambda df, what: df.where("error is not null").select(KEY, F.concat(F.lit(f"{what} of side "), "side", F.lit(": "), "error").alias("error"))
    failed = named(clean, "audio").unionByName(named(heard, "recognition")).unionByName(named(found, "diarization"))
    failed = scratch.settle(failed.groupBy(KEY).agg(F.min("error").alias("error")))
    good = lambda df: df.join(failed, KEY, "left_anti")
    tables = {}
    for s in "ab":
        of = lambda df: good(df.where(F.col("side") == s))  # noqa: B023, E731
        tables |= {f"words_{s}": speech.flatten_words(of(heard)), f"diarization_{s}": speech.diarization_turns(of(found)), f"embeddings_{s}": speech.speaker_embeddings(of(found))}
    sounds = wav.read_ranges(good(clean).select(KEY, "side", F.col("cleaned").alias("path")))
    return {name: scratch.settle(df) for name, df in tables.items()}, scratch.settle(envelopes(sounds)), failed


def count_warnings(tables: dict[str, DataFrame], requested: int) -> DataFrame:
    """Sides whose diarizer found another number of speakers than was asked for."""
    rows = tables["embeddings_a"].withColumn("side", F.lit("a")).unionByName(tables["embeddings_b"].withColumn("side", F.lit("b")))
    found = rows.groupBy(KEY, "side").agg(F.count("*").alias("n")).where(F.col("n") != requested)
    said = F.format_string(f"asked for {requested} speakers, found %d on side %s", "n", "side")
    return found.select(KEY, F.lit("speaker_count").alias("kind"), F.lit("warning").alias("severity"), said.alias("message"), F.lit(None).cast("double").alias("start"))


def render_capture(tables: dict[str, DataFrame], guard: bool = True) -> DataFrame:
    """recording, markdown of a captured fusion (turns_a, turns_b, embeddings_a, embeddings_b, offsets), with or without the
    containment guard."""
    missing = {"turns_a", "turns_b", "embeddings_a", "embeddings_b", "offsets"} - set(tables)
    if missing:
        raise ValueError(f"the capture lacks {sorted(missing)}")
    names = inverted(match_speakers(tables["embeddings_a"], tables["embeddings_b"], KEY))
    moved = shift_and_remap(tables["turns_b"], tables["offsets"], names)
    merged = merge_turns(tables["turns_a"], moved, **({} if guard else {"containment_min_chars": NO_GUARD}))
    return render_markdown(relabel_speakers(merged))
