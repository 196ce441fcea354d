"""Reports over transcripts and merges.  All of them call the production operators; none has its own merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bag_words, gap_seconds, is_backchannel, is_backchannel_squashed, loop_token, squashed, words
from .duplicates import near_duplicates
from .loops import repetition_loops, token_runs, turns_in_loops
from .merge import MAX_GAP, contained_neighbours, merge_turns, replacements
from .turns import smooth_micro_turns, smoothing_marks

KEY = "recording"
#: Words too common to be a sign of degeneration.
COMMON = tuple(
    "the and a to of i it that you in is so we yeah on for this but have with be not they just can do at if or as what was are there then all "
    "like up out one get go know think well right okay no he she will would from your my me us them how when which who about some more our their "
    "an by has had were been its".split()
)


def redundancy(turns: DataFrame) -> DataFrame:
    """distance, same_speaker, n: near-duplicate pairs of either kind, by distance; blocks in loops are not left out."""
    return near_duplicates(turns, cross_speaker=False).groupBy("distance", "same_speaker").agg(F.count("*").alias("n"))


def fragmentation(turns: DataFrame) -> DataFrame:
    """Per recording: blocks, short blocks, words in short blocks, sandwiched short blocks, neighbours of one speaker."""
    order = Window.partitionBy(KEY).orderBy("turn_idx")
    t = turns.withColumn("n", F.size(words(F.col("text")))).withColumn("before", F.lag("speaker").over(order)).withColumn("after", F.lead("speaker").over(order))
    short = lambda k: F.count_if(F.col("n") <= k)
    return t.groupBy(KEY).agg(
        F.count("*").alias("blocks"), short(1).alias("le_1"), short(2).alias("le_2"), short(3).alias("le_3"), short(5).alias("le_5"),
        F.sum("n").alias("words"), F.sum(F.when(F.col("n") <= 2, F.col("n")).otherwise(0)).alias("words_in_le_2"),
        F.count_if((F.col("n") <= 2) & (F.col("before") == F.col("after"))).alias("sandwiched"),
        F.count_if(F.col("before") == F.col("speaker")).alias("same_as_before"),
    )


def backchannel_split(turns: DataFrame, max_words: int = 2) -> DataFrame:
    """Per recording: short blocks, of which acknowledgements by the report's rule and by the smoothing's rule."""
    short = turns.where(F.size(words(F.col("text"))) <= max_words)
    return short.groupBy(KEY).agg(F.count("*").alias("short"), F.count_if(is_backchannel_squashed(F.col("text"))).alias("squashed"), F.count_if(is_backchannel(F.col("text"))).alias("by_word"))


def top_short_texts(turns: DataFrame, k: int = 8, max_words: int = 2) -> DataFrame:
    """The k most frequent squashed texts of short acknowledgements and of other short blocks; equal counts by first occurrence."""
    short = turns.where(F.size(words(F.col("text"))) <= max_words).select(KEY, "turn_idx", squashed(F.col("text")).alias("token"), is_backchannel_squashed(F.col("text")).alias("backchannel"))
    counted = short.groupBy("backchannel", "token").agg(F.count("*").alias("n"), F.min(F.struct(KEY, "turn_idx")).alias("first"))
    place = F.row_number().over(Window.partitionBy("backchannel").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= k).select("backchannel", "place", "token", "n")


def degeneration_within(turns: DataFrame, run: int = 4) -> DataFrame:
    """recording, turn_idx of blocks with run equal tokens, none of them empty, one after another; no shuffle."""
    # tokens, each with a mark before and after it, and one token that stands run times in a row
    token = F.transform(words(F.col("text")), lambda w: F.btrim(F.lower(w), F.lit(".,?!")))
    marked = F.concat(F.lit("\u0001"), F.array_join(token, "\u0001"), F.lit("\u0001"))
    return turns.where(marked.rlike(f"\u0001([^\u0001]+)(?:\u0001\\1){{{run - 1}}}\u0001")).select(KEY, "turn_idx")


def degeneration_docwide(turns: DataFrame, run: int = 4, k: int = 6) -> DataFrame:
    """The k longest runs of run equal tokens or more, across blocks."""
    return token_runs(turns, least=run).where((F.col("count") >= run) & (F.col("token") != "")).orderBy(F.desc("count"), KEY, "first_turn", "token").limit(k)


def dominant_tokens(turns: DataFrame, k: int = 40) -> DataFrame:
    """token, n, share of all tokens, for the k most frequent tokens (the empty one of bare punctuation too); equal counts by
    first occurrence."""
    t = turns.select(KEY, "turn_idx", F.posexplode(words(F.col("text"))).alias("pos", "w")).withColumn("token", loop_token(F.col("w")))
    counted = t.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(KEY, "turn_idx", "pos")).alias("first"))
    total = counted.agg(F.lit(1).alias("_one"), F.sum("n").alias("_total"))
    top = counted.orderBy(F.desc("n"), "first").limit(k).withColumn("_one", F.lit(1))
    return top.join(total, "_one").orderBy(F.desc("n"), "first").select("token", "n", (F.col("n") / F.col("_total")).alias("share"))


def suspicious_tokens(turns: DataFrame, k: int = 40, over: int = 50) -> DataFrame:
    """Of the k most frequent tokens those that occur more than over times and are no common words."""
    return dominant_tokens(turns, k).where((F.col("n") > over) & ~F.col("token").isin(*COMMON)).select("token", "n")


def origin_mix(merged: DataFrame) -> DataFrame:
    return merged.groupBy("_origin").agg(F.count("*").alias("n")).withColumnRenamed("_origin", "origin")


def cross_speaker_pairs(merged: DataFrame) -> DataFrame:
    """near_duplicates() of two speakers in a merge, with both origins and the seconds between the two spans.

    The pairs carry what is asked of both turns, so the merge, which is long, is computed once.
    """
    turns = merged.select(KEY, "turn_idx", "speaker", "start", "text", F.col("_origin").alias("origin"), F.col("start").alias("s"), F.col("end").alias("e"))
    pairs = near_duplicates(turns, carry=("origin", "s", "e"))
    return pairs.withColumn("gap", gap_seconds(F.col("s_i"), F.col("e_i"), F.col("s_j"), F.col("e_j"))).drop("s_i", "e_i", "s_j", "e_j")


def cross_speaker_origins(merged: DataFrame) -> DataFrame:
    """origins (both, in order of their names) and n of near-duplicate pairs of two speakers in a merge."""
    both = F.concat_ws(" + ", F.array_sort(F.array("origin_i", "origin_j")))
    return cross_speaker_pairs(merged).groupBy(both.alias("origins")).agg(F.count("*").alias("n"))


def cross_speaker_timing(merged: DataFrame) -> DataFrame:
    """same_time and different_time: near-duplicate pairs of two speakers whose spans touch or overlap, and others."""
    return cross_speaker_pairs(merged).agg(F.count_if(F.col("gap") == 0).alias("same_time"), F.count_if(F.col("gap") > 0).alias("different_time"))


def guard_fires(a: DataFrame, b: DataFrame, picks: DataFrame, radius: int = 4, max_gap: float = MAX_GAP) -> DataFrame:
    """recording, a_idx, turn_idx, step, same_speaker, chars: unreplaced turns near a replaced one whose words its new text holds."""
    near = contained_neighbours(a, b, picks, radius, max_gap)
    return near.where("chars > 0").select(KEY, "a_idx", "turn_idx", F.abs("step").alias("step"), (F.col("speaker") == F.col("sp")).alias("same_speaker"), "chars")


def guard_sweep(a: DataFrame, b: DataFrame, radii=(1, 2, 3, 4), floors=(0, 8, 20, 40)) -> DataFrame:
    """radius, min_chars, same_fires, cross_fires, chars: what the containment guard would drop at each setting.

    The turns are joined once, at the largest radius and without a floor; the settings are counts over that.
    """
    fires = guard_fires(a, b, replacements(a, b), max(radii))
    settings = [(r, f) for r in radii for f in floors]
    hit = lambda r, f: (F.col("step") <= r) & (F.col("chars") >= f)
    counts = [F.struct(F.lit(r).alias("radius"), F.lit(f).alias("min_chars"), F.count_if(hit(r, f) & F.col("same_speaker")).alias("same_fires"), F.count_if(hit(r, f) & ~F.col("same_speaker")).alias("cross_fires"), F.coalesce(F.sum(F.when(hit(r, f) & F.col("same_speaker"), F.col("chars"))), F.lit(0)).cast("long").alias("chars")) for r, f in settings]
    return fires.agg(F.array(*counts).alias("s")).select(F.inline("s"))


def smoothing_report(turns: DataFrame, threshold: int = 10) -> DataFrame:
    """Per recording: turns, eligible, absorbed, and eligible ones inside repetition loops."""
    m = _marked(turns, threshold)
    return m.groupBy(KEY).agg(F.count("*").alias("turns"), F.count_if("eligible").alias("eligible"), F.count_if("absorbed").alias("absorbed"), F.count_if(F.col("eligible") & F.col("looped").isNotNull()).alias("eligible_in_loops"))


def _marked(turns: DataFrame, threshold: int) -> DataFrame:
    """smoothing_marks() with looped, true for turns inside repetition loops and else null."""
    looped = turns_in_loops(turns, repetition_loops(turns, threshold)).withColumn("looped", F.lit(True))
    return smoothing_marks(turns).join(looped, [KEY, "turn_idx"], "left")


def smoothing_exclusions(turns: DataFrame) -> DataFrame:
    """Per recording: short turns between two of one other speaker, how many of them the smoothing leaves because they last, how
    many for the word list alone, and the texts of the latter with their counts, in order: what either rule is worth."""
    m = smoothing_marks(turns).where(F.col("eligible") | F.col("kept_by").isNotNull())
    by_text = m.groupBy(KEY, "text", "eligible", "kept_by").agg(F.count("*").alias("n"))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    listed = F.array_sort(F.collect_list(F.when(F.col("kept_by") == "word list", F.struct("text", "n"))))
    return by_text.groupBy(KEY).agg(
        F.sum("n").alias("short"),
        total(F.col("kept_by") == "duration").alias("by_duration"),
        total(F.col("kept_by") == "word list").alias("by_word_list"),
        F.array_join(F.transform(listed, lambda x: F.concat(x["text"], F.lit(" "), x["n"].cast("string"))), ", ").alias("words_listed"),
    )


def smoothing_candidates(turns: DataFrame, threshold: int = 10, chars: int = 70) -> DataFrame:
    """Eligible turns outside repetition loops with what is said around them, to be judged by hand: recording, turn_idx, speaker,
    start, text, into (the speaker around it), before (the last characters of the turn before) and after (the first of the next).

    A turn stands between the turns next to it in order, whatever their numbers.
    """
    order = Window.partitionBy(KEY).orderBy("turn_idx")
    said = turns.select(KEY, "turn_idx", F.lag("speaker").over(order).alias("into"), F.substring(F.lag("text").over(order), -chars, chars).alias("before"), F.substring(F.lead("text").over(order), 1, chars).alias("after"))
    clean = _marked(turns, threshold).where(F.col("eligible") & F.col("looped").isNull())
    return clean.join(said, [KEY, "turn_idx"]).select(KEY, "turn_idx", "speaker", "start", "text", "into", "before", "after")


def word_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """word, removed, added where the word counts of two turn tables differ; a word is lost if after holds none."""
    bag = lambda df, n: df.select(F.explode(bag_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias(n))
    both = bag(before, "b").join(bag(after, "a"), "word", "full").na.fill(0, ["a", "b"])
    removed, added = F.greatest(F.col("b") - F.col("a"), F.lit(0)), F.greatest(F.col("a") - F.col("b"), F.lit(0))
    return both.select("word", removed.alias("removed"), added.alias("added"), ((F.col("b") > 0) & (F.col("a") == 0)).alias("lost")).where("removed > 0 or added > 0")


def guard_losses(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the containment guard removes from a merge, word by word."""
    return word_difference(merge_turns(a, b, containment_min_chars=1_000_000_000), merge_turns(a, b))


def smoothing_losses(turns: DataFrame) -> DataFrame:
    return word_difference(turns, smooth_micro_turns(turns))


def multiset_fingerprint(df: DataFrame) -> tuple[int, int]:
    """How many rows, and the sum of their 128-bit hashes modulo 2**128: equal for the same rows in whatever order, each as often.

    One aggregation without a shuffle of rows; tables that differ agree with a chance of about 2**-128.  A null is told from every value.
    """
    row = F.to_json(F.struct(*[F.struct(F.col(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    digest = F.md5(row.cast("binary"))
    quarter = lambda k: F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)"))
    found = df.agg(F.count("*"), *[quarter(k) for k in range(4)]).first()
    return found[0], sum(int(found[k + 1] or 0) << 32 * (3 - k) for k in range(4)) % (1 << 128)


def assert_same_turns(instrument: DataFrame, production: DataFrame) -> None:
    """Fails unless both hold the same rows, equal rows as often; columns whose names begin with _ do not count."""
    columns = [c for c in production.columns if not c.startswith("_")]
    x, y = multiset_fingerprint(instrument.select(columns)), multiset_fingerprint(production.select(columns))
    if x != y:
        raise AssertionError(f"the instrument disagrees with production: {x[0]} rows against {y[0]}, digests {x[1]:x} and {y[1]:x}; its numbers are invalid")
