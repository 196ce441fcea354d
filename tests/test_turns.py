import random

import pytest

from tests.helpers import listed, many, turns
from turnweave import schemas
from turnweave.operators import align, loops, turns as ops
from turnweave.operators.duplicates import cross_speaker_duplicates, near_duplicates
from turnweave.operators.render import parse_blocks, render_markdown
from turnweave.sources import speech


def words_df(spark, rows):
    return spark.createDataFrame([("r", i, w, float(a), float(b), 0.9) for i, (w, a, b) in enumerate(rows)], schemas.WORDS)


def dturns_df(spark, rows):
    return spark.createDataFrame([("r", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], schemas.DIARIZATION)


def test_align(spark):
    w = words_df(spark, [(" a", 4.8, 5.6)])
    assert listed(align.align_words(w, dturns_df(spark, [(0, 5, "S0"), (5, 10, "S1")])), "speaker") == [("S1",)]
    w = words_df(spark, [(" a", 3.6, 3.8)])
    assert listed(align.align_words(w, dturns_df(spark, [(0, 2, "S0"), (4, 6, "S1")])), "speaker") == [("S1",)]


def test_align_ties_and_words_without_duration(spark):
    w = words_df(spark, [(" tie", 4, 6), (" point", 5, 5), (" far", 100, 101)])
    found = align.align_words(w, dturns_df(spark, [(0, 5, "S0"), (5, 10, "S1"), (4.9, 5.0, "S2")])).orderBy("word_idx")
    assert [r["speaker"] for r in found.collect()] == ["S0", "S0", "S1"]


def test_align_random_against_loops(spark):
    rng = random.Random(1)
    rows = [(" w", a := rng.randint(0, 300) / 2, a + rng.randint(0, 4) / 2) for _ in range(150)]
    ts = sorted((a := rng.randint(0, 300) / 2, a + rng.randint(0, 80) / 2, f"S{rng.randint(0, 3)}") for _ in range(30))
    want = []
    for _, a, b in rows:
        overlaps = [max(0, min(b, te) - max(a, ts_)) for ts_, te, _ in ts]
        if max(overlaps) > 0:
            want.append(ts[overlaps.index(max(overlaps))][2])
        else:
            near = [min(abs(a - te), abs(ts_ - b)) for ts_, te, _ in ts]
            want.append(ts[near.index(min(near))][2])
    got = align.align_words(words_df(spark, rows), dturns_df(spark, ts)).orderBy("word_idx")
    assert [r["speaker"] for r in got.collect()] == want


def test_nearest_edges_over_empty_cells(spark):
    """Edges far before, after and apart, with many cells between; no frame of the plan is unbounded."""
    rng = random.Random(4)
    ts = sorted((a := rng.choice((-500, 0, 900, 901, 5000)) + rng.randint(0, 40), a + rng.randint(0, 50), f"S{rng.randint(0, 2)}") for _ in range(14))
    rows = [(" w", t := rng.choice((-3000, -500, 30, 60, 450, 930, 2950, 5050, 9000)) + rng.randint(0, 30) / 2, t + rng.choice((0, 0, 1, 70))) for _ in range(120)]
    near = lambda a, b: min((min(abs(a - e), abs(s - b)), k) for k, (s, e, _) in enumerate(ts))[1]
    found = align.align_nearest(words_df(spark, rows), dturns_df(spark, ts))
    assert {r["word_idx"]: r["speaker"] for r in found.collect()} == {i: ts[near(a, b)][2] for i, (_, a, b) in enumerate(rows)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_align_without_turns_fails(spark):
    with pytest.raises(Exception, match="no speaker turns"):
        align.align_words(words_df(spark, [(" a", 0, 1)]), dturns_df(spark, [])).collect()


def test_group_and_relabel(spark):
    said = {"north": [("late", "Rain", 0.25), ("late", " tomorrow,", 0.75), ("late", " he says.", 0.5), ("early", " Snow.", 0.125)], "south": [("early", " ", 1.0), ("late", "No", 0.0)]}
    rows = [(r, 10 * i, w, 7.0 * i, 7.0 * i + 4, p, s) for r, x in said.items() for i, (s, w, p) in enumerate(x)]
    grouped = ops.group_into_turns(spark.createDataFrame(rows[::-1], schemas.ALIGNED))
    assert listed(grouped, "recording", "speaker", "text", "start", "end", "confidence") == [
        ("north", "Person 1", "Rain tomorrow, he says.", 0, 18, 0.5), ("north", "Person 2", "Snow.", 21, 25, 0.125),
        ("south", "Person 1", "", 0, 4, 1.0), ("south", "Person 2", "No", 7, 11, 0.0),
    ]


def smoothed(rows):
    """One pass from left to right, as a check of the closed form."""
    out, i = [], 0
    while i < len(rows):
        s, a, b, t, c = rows[i]
        if out and i + 1 < len(rows) and rows[i - 1][0] == rows[i + 1][0] != s and len(t.split()) <= 2 and b == a and t.lower() not in ("yeah", "ok") and out[-1][0] == rows[i + 1][0]:
            p, n = out[-1], rows[i + 1]
            out[-1] = (p[0], p[1], n[2], " ".join(x for x in (p[3], t, n[3]) if x), min(p[4], c, n[4]))
            i += 2
        else:
            out.append(rows[i])
            i += 1
    return out


def test_smoothing(spark):
    rows = [("S0", 0, 5, "so", 0.9), ("S1", 5, 5, "the", 0.3), ("S0", 5, 9, "end", 0.8)]
    assert listed(ops.smooth_micro_turns(turns(spark, rows)), "speaker", "start", "end", "text", "confidence") == [("S0", 0, 9, "so the end", 0.3)]
    for middle in (("S1", 5, 5, "Yeah"), ("S1", 5, 5, "yeah okay"), ("S1", 5, 5.3, "the"), ("S1", 5, 5, "one two three")):
        assert ops.smooth_micro_turns(turns(spark, [rows[0], middle, rows[2]])).count() == 3
    assert ops.smooth_micro_turns(turns(spark, [rows[0], rows[1], ("S2", 5, 9, "end")])).count() == 3


def test_smoothing_random(spark):
    rng = random.Random(3)
    all_rows, want = {}, []
    for k in range(40):
        rows = [(f"S{rng.randint(0, 1)}", i, i + rng.choice([0, 0, 1]), rng.choice(["a", "b c", "yeah", "x y z", ""]), rng.randint(1, 9) / 10) for i in range(rng.randint(1, 14))]
        all_rows[f"r{k:02}"] = rows
        want += [(f"r{k:02}", *x) for x in smoothed(rows)]
    assert listed(ops.smooth_micro_turns(many(spark, all_rows)), "recording", "speaker", "start", "end", "text", "confidence") == want


def test_loops(spark):
    rows = [(f"S{i % 3}", i, i + 1, "Lars." if 5 <= i <= 44 else f"w{i}") for i in range(60)]
    t = turns(spark, rows)
    found = loops.repetition_loops(t)
    assert [tuple(r) for r in found.select("token", "count", "start", "end").collect()] == [("lars", 40, 5.0, 44.0)]
    assert loops.turns_in_loops(t, found).count() == 40
    for n, hits in ((9, 0), (10, 1)):
        assert loops.repetition_loops(turns(spark, [("S", 0, 1, "a " + "la, " * n + "b")])).count() == hits
    assert loops.repetition_loops(turns(spark, [("S", 0, 1, "... " * 12)])).count() == 0


SENTENCE = "the quick brown fox jumps over the lazy dog again now"


def test_duplicates(spark):
    pair = lambda a, b, gap=0: turns(spark, [("P1", 0, 1, a), *[("P3", i, i, f"filler {i}") for i in range(gap)], ("P2", 9, 10, b)])
    assert [tuple(r) for r in cross_speaker_duplicates(pair(SENTENCE, SENTENCE.upper() + "!")).select("first_speaker", "second_speaker", "shared_chars").collect()] == [("P1", "P2", len(SENTENCE))]
    assert cross_speaker_duplicates(pair(SENTENCE, SENTENCE, 4)).count() == 1
    assert cross_speaker_duplicates(pair(SENTENCE, SENTENCE, 5)).count() == 0
    assert cross_speaker_duplicates(pair(SENTENCE[:40], SENTENCE[:40])).count() == 0
    assert cross_speaker_duplicates(pair(SENTENCE[:41], SENTENCE[:41])).count() == 1
    assert cross_speaker_duplicates(pair(SENTENCE + "x" * 70, SENTENCE + "y" * 70)).count() == 0
    assert near_duplicates(turns(spark, [("P1", 0, 1, SENTENCE), ("P1", 1, 2, SENTENCE)])).count() == 0
    assert near_duplicates(turns(spark, [("P1", 0, 1, SENTENCE), ("P1", 1, 2, SENTENCE)]), cross_speaker=False).count() == 1
    looped = [(f"P{i % 2}", i, i + 1, "paul " * 12) for i in range(6)]
    assert cross_speaker_duplicates(turns(spark, looped)).count() == 0


def test_render_and_parse(spark):
    t = turns(spark, [("Person 1", 3, 4, "Hello."), ("Person 2", 3725, 3726, "Two\nlines ## here")])
    text = render_markdown(t).collect()[0]["markdown"]
    assert text == "## Person 1 — 00:03\n\nHello.\n\n## Person 2 — 01:02:05\n\nTwo\nlines ## here\n"
    back = parse_blocks(render_markdown(t))
    assert listed(back, "speaker", "stamp", "text", order=("block_idx",)) == [("Person 1", "00:03", "Hello."), ("Person 2", "01:02:05", "Two\nlines ## here")]


def test_flatten_and_diarization_order(spark):
    row = [("r", [{"start": 0.0, "end": 1.0, "text": "a b", "words": [{"word": " a", "start": 0.0, "end": 0.5, "probability": 0.9}, {"word": " b", "start": 0.5, "end": 1.0, "probability": 0.8}]}, {"start": 0.2, "end": 1.0, "text": "c", "words": [{"word": " c", "start": 0.1, "end": 1.0, "probability": 0.7}]}])]
    kind = schemas.ASR.split(", text string, language")[0]
    assert [r["word"] for r in speech.flatten_words(spark.createDataFrame(row, f"recording string, {kind}")).orderBy("word_idx").collect()] == [" a", " b", " c"]

    def make():
        return lambda path, **options: {"tracks": [(4, 5, 10), (0, 1, 2), (0, 2, 10)], "labels": [2, 10], "embeddings": [[0, 1], [1, 0]]}

    files = spark.createDataFrame([("r", "x.wav")], "recording string, path string")
    got = speech.diarize(files, make, num_speakers=3)
    assert listed(speech.diarization_turns(got), "speaker", "start", "end", order=("dturn_idx",)) == [("2", 0, 1), ("10", 0, 2), ("10", 4, 5)]
    assert listed(speech.speaker_embeddings(got), "speaker", "embedding", order=("label_idx",)) == [("2", [0, 1]), ("10", [1, 0])]
    assert speech.speaker_count_warnings(got, 3).count() == 1
    broken = speech.diarize(files, lambda: lambda path: {}["x"]).collect()[0]
    assert "DiarizationError" in broken["error"]
