"""Queries of the transcript operators over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stamp, stamp_seconds
from ..operators import align, duplicates, loops, match, merge, offset, render, reports, turns
from ..sources import media, speech
from ..sources import projections as p
from ..sources.scratch import Scratch
from .sql import ORACLE

KEY = "recording"


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return df.select(KEY, "turn_idx", "speaker", r("start"), r("end"), "text", r("confidence"), *more)


def media_filter(spark, d):
    tail = F.element_at(F.create_map(F.lit(0), F.lit("/a.MP3"), F.lit(1), F.lit("/b.mov"), F.lit(2), F.lit("/c.txt"), F.lit(3), F.lit("")), (F.col("page_id") % 4).cast("int"))
    files = p.table(spark, d, "pages").select("page_id", F.concat("url", tail).alias("path"))
    return files.where(media.is_media(F.col("path")))


def word_flatten(spark, d):
    return speech.flatten_words(p.recogniser_results(spark, d)).select(KEY, "word_idx", "word", "start", "end")


def group_consecutive(spark, d):
    return _rounded(turns.group_consecutive(p.event_words(spark, d)))


def relabel_speakers(spark, d):
    return turns.relabel_speakers(p.turns_a(spark, d)).select(KEY, "turn_idx", "speaker")


def format_timestamp(spark, d):
    return p.turns_a(spark, d).select(KEY, "turn_idx", stamp(F.col("start")).alias("stamp"), stamp(F.col("start") * 60).alias("long_stamp"))


def render_markdown(spark, d):
    return render.render_markdown(turns.relabel_speakers(p.turns_a(spark, d)))


def parse_blocks(spark, d):
    return render.parse_blocks(render_markdown(spark, d)).select(KEY, "block_idx", "speaker", "stamp", stamp_seconds(F.col("stamp")).alias("seconds"), "text")


def align_overlap(spark, d):
    return align.align_overlap(p.spoken_words(spark, d), p.diarized(spark, d))


def align_nearest(spark, d):
    w, t = p.spoken_words(spark, d), p.diarized(spark, d)
    return align.align_nearest(w.join(align.align_overlap(w, t), [KEY, "word_idx"], "left_anti"), t)


def align_words(spark, d):
    return align.align_words(p.spoken_words(spark, d), p.diarized(spark, d)).select(KEY, "word_idx", "speaker")


def repetition_loops(spark, d):
    return loops.repetition_loops(p.event_turns(spark, d), 4).select(KEY, "token", "count", "start", "end")


def in_loop_blocks(spark, d):
    t = p.event_turns(spark, d)
    return loops.turns_in_loops(t, loops.repetition_loops(t, 4))


def backchannel_split(spark, d):
    return reports.backchannel_split(p.table(spark, d, "documents").select(F.col("lang").alias(KEY), "text"))


def smooth_micro_turns(spark, d):
    return _rounded(turns.smooth_micro_turns(p.event_turns(spark, d)), "n_merged")


def smoothing_report(spark, d):
    return reports.smoothing_report(p.event_turns(spark, d), 4)


def cross_speaker_duplicates(spark, d):
    return duplicates.cross_speaker_duplicates(p.document_blocks(spark, d)).select(KEY, "i", "j", "distance", "first_speaker", "second_speaker", "start", "shared_chars")


def redundancy_by_distance(spark, d):
    return reports.redundancy(p.document_blocks(spark, d))


def top_duplicates(spark, d):
    return duplicates.top_duplicates(cross_speaker_duplicates(spark, d)).select(KEY, "i", "j", "distance", "start", "shared_chars", "n_more")


def fragmentation(spark, d):
    return reports.fragmentation(p.turns_a(spark, d))


def degeneration_within(spark, d):
    docs = p.table(spark, d, "documents").select(F.col("lang").alias(KEY), F.col("doc_id").alias("turn_idx"), "text")
    return reports.degeneration_within(docs)


def degeneration_docwide(spark, d):
    return reports.degeneration_docwide(p.event_turns(spark, d)).select(KEY, "token", "count", "start", "end")


def dominant_tokens(spark, d):
    return reports.dominant_tokens(p.turns_a(spark, d)).withColumn("share", F.round("share", 9))


def suspicious_tokens(spark, d):
    return reports.suspicious_tokens(p.turns_a(spark, d))


def top_short_texts(spark, d):
    return reports.top_short_texts(p.word_blocks(spark, d))


def rms_envelope(spark, d):
    return p.envelope_pair(spark, d).select("side", "win_idx", F.round("rms", 6).alias("rms"))


def cross_correlation(spark, d):
    return offset.cross_correlation(p.envelope_pair(spark, d)).select("lag", F.round("corr", 2).alias("corr"), "overlap")


def offset_confidence(spark, d):
    found = offset.offsets(offset.cross_correlation(p.envelope_pair(spark, d)))
    return found.select(F.round("offset_s", 6).alias("offset_s"), F.round("confidence", 6).alias("confidence"), "weak")


def _controls(spark, d):
    return offset.control_report(p.envelope_pair(spark, d))


def offset_controls(spark, d):
    ratios = [F.round(c, 4).alias(c) for c in ("peak_over_rival", "peak_over_median")]
    return _controls(spark, d).select("pair_id", F.round("offset_s", 6).alias("offset_s"), *ratios, *[F.round(c, 0).alias(c) for c in ("least", "most", "median", "deviation")])


def offset_separation(spark, d):
    return offset.separation(_controls(spark, d)).select("pair_id", *[F.round(c, 4).alias(c) for c in ("true", "null_min", "null_median", "null_max", "separation", "midpoint")])


def cosine_matrix(spark, d):
    return match.cosine_matrix(*p.voices(spark, d)).select("meeting", "speaker_a", "speaker_b", F.round("similarity", 6).alias("similarity"))


def match_speakers(spark, d):
    return match.match_speakers(*p.voices(spark, d)).select("meeting", "speaker_a", "speaker_b")


def smoothing_exclusions(spark, d):
    return reports.smoothing_exclusions(p.acknowledged_turns(spark, d))


def smoothing_candidates(spark, d):
    return reports.smoothing_candidates(p.acknowledged_turns(spark, d), 4, 3)


def _fusion(spark, d, echoes=False):
    return p.turns_a(spark, d, echoes), merge.shift_and_remap(p.raw_turns_b(spark, d, echoes), *p.clock_and_labels(spark, d))


def shift_and_remap(spark, d):
    return _rounded(_fusion(spark, d)[1])


def merge_replacement(spark, d):
    return merge.replacements(*_fusion(spark, d))


def containment_consumed(spark, d):
    a, b = _fusion(spark, d)
    return merge.consumed_siblings(a, b, merge.replacements(a, b))


def gapfill_coverage(spark, d):
    return _rounded(merge.gap_filling(*_fusion(spark, d)))


def merge_turns(spark, d):
    return _rounded(merge.merge_turns(*_fusion(spark, d)).withColumnRenamed("_origin", "origin"), "origin")


def merge_origin_mix(spark, d):
    return reports.origin_mix(merge.merge_turns(*_fusion(spark, d)))


def _merged_echoes(spark, d):
    """The merge of both recordings with echoes.  Both are written once, as fuse() does: the merge reads each of them many times."""
    settle = Scratch(spark).settle
    return merge.merge_turns(*[settle(side) for side in _fusion(spark, d, echoes=True)])


def cross_speaker_origins(spark, d):
    return reports.cross_speaker_origins(_merged_echoes(spark, d))


def cross_speaker_timing(spark, d):
    return reports.cross_speaker_timing(_merged_echoes(spark, d))


def guard_sweep(spark, d):
    return reports.guard_sweep(*_fusion(spark, d))


def lossless_diff(spark, d):
    return reports.guard_losses(*_fusion(spark, d))


def smoothing_lossless(spark, d):
    return reports.smoothing_losses(p.event_turns(spark, d)).agg(F.count("*").alias("words_that_differ"))


QUERIES = {
    f.__name__: f
    for f in (
        media_filter, word_flatten, group_consecutive, relabel_speakers, format_timestamp, render_markdown, parse_blocks,
        align_overlap, align_nearest, align_words, repetition_loops, in_loop_blocks, backchannel_split, smooth_micro_turns,
        smoothing_report, cross_speaker_duplicates, redundancy_by_distance, top_duplicates, fragmentation, degeneration_within,
        degeneration_docwide, dominant_tokens, suspicious_tokens, top_short_texts, rms_envelope, cross_correlation, offset_confidence,
        offset_controls, offset_separation, cosine_matrix, match_speakers, shift_and_remap, merge_replacement,
        containment_consumed, gapfill_coverage, merge_turns, merge_origin_mix, cross_speaker_origins, cross_speaker_timing, guard_sweep,
        lossless_diff, smoothing_lossless, smoothing_exclusions, smoothing_candidates,
    )
}
#: Assignments have no SQL; tests hold them against brute force.
ORACLE_SQL = {name: ORACLE[name] for name in QUERIES if name in ORACLE}
