"""Spans of any length on cells, runs over ranges, islands of a merge."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import listed, many, turns
from turnweave import schemas
from turnweave.operators import align, loops, merge, spans
from turnweave.operators import turns as ops

SPAN = "recording string, word_idx long, start double, end double"


def test_few_rows_for_long_spans(spark):
    """Ten hours take a few cells of thirty seconds and more, and short spans stay on the least cells where all are short."""
    hours = spark.createDataFrame([("r", k, 17.0 + 90 * k, 17.0 + 90 * k + 36_000) for k in range(50)], SPAN)
    short = spark.createDataFrame([("r", k, 4.0 * k, 4.0 * k + 3) for k in range(200)], SPAN)
    rows = lambda x, y: spans.on_cells(x, y, "start", "end", "own", 30.0).groupBy("word_idx").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert rows(hours, short) < 40 and rows(hours, hours) < 40
    assert rows(short, short) <= 2 and rows(short, hours) <= 8


@pytest.mark.parametrize("seconds", [0.5, 30.0])
def test_overlaps_of_all_lengths(spark, seconds):
    rng = random.Random(int(seconds * 10))
    draw = lambda: (lambda s, n: (s, s + n))(rng.choice([-40.0, 0.0, 30.0, 960.0, rng.uniform(-100, 200_000)]), rng.choice([0.0, 0.25, 3.0, 30.0, 31.0, 900.0, 36_000.0, 2e6]))
    w, t = ([draw() for _ in range(150)] for _ in range(2))
    left = spark.createDataFrame([("r", k, *x) for k, x in enumerate(w)], SPAN)
    right = spark.createDataFrame([("r", k, *x, "S") for k, x in enumerate(t)], "recording string, dturn_idx long, start double, end double, speaker string")
    want = sorted((i, j) for i, (a, b) in enumerate(w) for j, (c, d) in enumerate(t) if a < b and c < d and max(a, c) < min(b, d))
    got = sorted((r["word_idx"], r["dturn_idx"]) for r in align.overlapping(left, right, seconds).collect())
    assert got == want and len(want) > 1000


def test_overlaps_without_rows(spark):
    none = spark.createDataFrame([], "recording string, dturn_idx long, start double, end double, speaker string")
    assert align.overlapping(spark.createDataFrame([("r", 0, 0.0, 1.0)], SPAN), none).count() == 0


def test_turns_in_loops_of_all_lengths(spark):
    rng = random.Random(5)
    asked = [rng.uniform(0, 100_000) for _ in range(200)]
    found = [(s, s + rng.choice([0.0, 20.0, 5000.0, 40_000.0])) for s in [*rng.sample(asked, 6), 10.0]]
    t = turns(spark, [("S", s, s + 1, "x") for s in asked])
    spoken = spark.createDataFrame([("r", *x) for x in found], "recording string, start double, end double")
    want = sorted(i for i, s in enumerate(asked) if any(a <= s <= b for a, b in found))
    assert sorted(r["turn_idx"] for r in loops.turns_in_loops(t, spoken).collect()) == want


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_runs_over_ranges(spark, monkeypatch, span):
    """However a recording is cut into ranges, runs are those of the whole; ranges may lack rows and values may be null."""
    monkeypatch.setattr(ops, "RANGE_WORDS", span)
    monkeypatch.setattr(loops, "RANGE_TURNS", span)
    rng = random.Random(span)
    said, want, repeats = [], [], []
    for r in ("p", "q"):
        place, last, run = 0, None, -1
        for _ in range(60):
            place += rng.choice([1, 1, 1, 9])
            speaker = rng.choice(["A", "A", "A", "B", None])
            fresh = run < 0 or (speaker is not None and last is not None and speaker != last)
            run, last = run + fresh, speaker
            said.append((r, place, f" {place}", float(place), place + 1.0, 0.5, speaker))
            want = [*want[:-1], (r, run, want[-1][2] + f" {place}")] if not fresh else [*want, (r, run, str(place))]
    got = ops.group_consecutive(spark.createDataFrame(said, schemas.ALIGNED))
    assert listed(got, "recording", "turn_idx", "text") == want

    texts = {r: [("S", k, k + 1, " ".join(rng.choices("ab", weights=(4, 1), k=rng.randint(0, 3))), 0.5) for k in range(40)] for r in ("p", "q")}
    for r, rows in texts.items():
        tokens = [(k, w) for k, (*_, text, _) in enumerate(rows) for w in text.split()]
        for n, (k, w) in enumerate(tokens):
            if n and tokens[n - 1][1] == w:
                repeats[-1][2:] = [repeats[-1][2] + 1, k]
            else:
                repeats.append([r, w, 1, k])
    found = loops.token_runs(many(spark, texts))
    assert sorted((x["recording"], x["last_turn"], x["token"], x["count"]) for x in found.collect()) == sorted((r, k, w, n) for r, w, n, k in repeats)


def test_islands_bound_the_fold(spark):
    """Candidates far apart are folded apart; those that share a candidate stay together."""
    a = [("S", 100 * k + x, 100 * k + x + 2, "a", 0.1) for k in range(50) for x in (0, 3)]
    b = [("S", 100 * k + 1, 100 * k + 4, "b", 0.9) for k in range(50)]
    lists = merge.candidates(turns(spark, a), turns(spark, b)).select(F.size("rows").alias("n")).collect()
    assert len(lists) == 50 and {r["n"] for r in lists} == {2}
    picks = merge.replacements(turns(spark, a), turns(spark, b)).collect()
    assert sorted((r["a_idx"], r["b_idx"]) for r in picks) == [(2 * k, k) for k in range(50)]
