"""Runs of one repeated token, as a failing recogniser makes them, and turns inside such runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import loop_token, words
from .scan import numbered_runs
from .spans import AT, on_cells

KEY = "recording"
THRESHOLD = 10
#: Turns that one task numbers at a time.
RANGE_TURNS = 4096
#: Name of a column that holds turn_runs() with this least.
RUNS = "_runs_{}"


def turn_runs(text: Column, least: int = 1, token=loop_token) -> Column:
    """The runs of equal tokens of one text as an array of (pos, token, count), without those shorter than least that neither
    begin nor end the text."""
    tokens = F.transform(words(text), token)
    # the tokens beside themselves by one place, with nulls at both ends: true where a run begins, and after the last
    opens = lambda t: F.zip_with(F.concat(t, F.array(F.lit(None).cast("string"))), F.concat(F.array(F.lit(None).cast("string")), t), lambda x, y: ~x.eqNullSafe(y))
    places = lambda t: F.filter(F.transform(opens(t), lambda new, k: F.when(new, k)), lambda k: k.isNotNull())
    of_one = lambda t, at: F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("pos"), F.get(t, p).alias("token"), (q - p).cast("long").alias("count"), (q == F.size(t)).alias("last")))
    # a lambda over an array of one element names a value once, so that it is not computed again for each token
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    runs = bind(tokens, lambda t: bind(places(t), lambda at: of_one(t, at)))
    return F.filter(runs, lambda r: (r["pos"] == 0) | r["last"] | (r["count"] >= least))


def token_runs(turns: DataFrame, token=loop_token, least: int = 1) -> DataFrame:
    """recording, token, count, start, end, first_turn, last_turn of runs of equal tokens across turn borders: of every run of least
    tokens or more, and of some shorter ones.

    A turn's own runs are found in place (or taken from the column RUNS for least), and only those that may go on in
    other turns or are long enough are sent on.
    """
    found = RUNS.format(least)
    if found not in turns.columns or token is not loop_token:
        turns = turns.withColumn(found, turn_runs(F.col("text"), least, token))
    parts = turns.select(KEY, "turn_idx", "start", F.explode(found).alias("_r")).select(KEY, "turn_idx", "start", "_r.pos", "_r.token", "_r.count")
    # a run that begins inside its turn is not the one before it, even where those between them were left out
    runs = numbered_runs(parts, F.col("token"), ["turn_idx", "pos"], RANGE_TURNS, "_run", F.col("pos") > 0)
    at = F.struct("turn_idx", "pos")
    return runs.groupBy(KEY, "_run").agg(
        F.first("token").alias("token"),
        F.sum("count").alias("count"),
        F.min_by("start", at).alias("start"),
        F.max_by("start", at).alias("end"),
        F.min("turn_idx").alias("first_turn"),
        F.max("turn_idx").alias("last_turn"),
    ).drop("_run")


def repetition_loops(turns: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Runs of threshold tokens or more; start and end are the starts of the turns of the first and last token."""
    return token_runs(turns, least=threshold).where((F.col("count") >= threshold) & (F.col("token") != ""))


def turns_in_loops(turns: DataFrame, loops: DataFrame, cell_seconds: float = 60.0) -> DataFrame:
    """turn_idx of turns that start within a loop's span (both ends included), of any speaker: a semi-join on time cells
    of several sizes."""
    spans = loops.select(KEY, F.least("start", "end").alias("lo"), F.col("start").alias("ls"), F.col("end").alias("le"))
    asked = turns.select(KEY, "turn_idx", "start", F.col("start").alias("upto"))
    t = on_cells(asked, spans, "start", "upto", "_t", cell_seconds, "lo", "le").alias("t")
    c = on_cells(spans, asked, "lo", "le", "_c", cell_seconds, "start", "upto").where(F.col("_size") == F.col("_c")).alias("c")
    same = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in (KEY, *AT)]
    cond = same[0] & same[1] & same[2] & F.col("t.start").between(F.col("c.ls"), F.col("c.le"))
    return t.join(c, cond, "left_semi").select(KEY, "turn_idx").distinct()
