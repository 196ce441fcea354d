"""Near-duplicates without regard to how many blocks a recording has or how their texts repeat."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import many, turns
from tests.test_catalog import longest_common, written
from turnweave.functions.text import duplicate_string, duplicate_text
from turnweave.operators import duplicates, loops, reports
from turnweave.plans import catalog


def test_strings_are_squashed_as_columns_are(spark):
    texts = ["A b\n C-9", "KİΣ ß", "", "naïve  café\t1", "中 x", "\U0001d400A"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", duplicate_text(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [duplicate_string(t) for t in texts]


@pytest.mark.parametrize("most", [0, 2, 64])
def test_runs_are_the_longest(monkeypatch, most):
    monkeypatch.setattr(duplicates, "MOST_PIECES", most)
    rng = random.Random(most)
    for _ in range(400):
        letters, common = rng.choice(["a", "ab", "abcdefgh"]), "".join(rng.choices("abxy", k=rng.randint(0, 60)))
        noise = lambda n: "".join(rng.choices(letters, k=n))  # noqa: E731, B023
        a, b = (noise(rng.randint(0, 40)) + common + noise(rng.randint(0, 40)) for _ in "ab")
        least = max(5, int(0.5 * min(len(a), len(b))) + 1)
        n = longest_common(a, b)
        assert duplicates.shared_run(duplicates.Text(a, 5), duplicates.Text(b, 5), least) == (n if n >= least else 0)


def test_pairs_meet_across_cells(spark, monkeypatch):
    """Every pair up to the distance is found once wherever cells end, and pairs carry columns of both."""
    text = "the same long sentence over and over again until it ends"
    rows = [(f"S{i % 2}", i, i + 1, text if i % 7 < 4 else "short") for i in range(60)]
    for width in (1, 8, 128):
        monkeypatch.setattr(duplicates, "CELL_BLOCKS", width)
        got = duplicates.near_duplicates(turns(spark, rows), cross_speaker=False, carry=("end",)).collect()
        want = [(i, j) for i in range(60) for j in range(i + 1, min(i + 6, 60)) if i % 7 < 4 and j % 7 < 4]
        assert sorted((r["i"], r["j"]) for r in got) == want
        assert all((r["end_i"], r["end_j"]) == (r["i"] + 1, r["j"] + 1) for r in got)


def test_short_runs_inside_turns_are_not_sent(spark):
    texts = [("S", k, k + 1, t, 0.5) for k, t in enumerate(["a b b a", "a", "", "a c c c c a", "a a", "d", "d e d", "d"])]
    table = many(spark, {"r": texts})
    every = sorted((r["first_turn"], r["last_turn"], r["token"], r["count"]) for r in loops.token_runs(table).collect())
    some = sorted((r["first_turn"], r["last_turn"], r["token"], r["count"]) for r in loops.token_runs(table, least=3).collect())
    assert [r for r in some if r[3] >= 3] == [r for r in every if r[3] >= 3] == [(0, 3, "a", 3), (3, 3, "c", 4), (3, 4, "a", 3)]
    assert (0, 0, "b", 2) in every and (0, 0, "b", 2) not in some and (6, 6, "e", 1) not in some


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_merges_are_made_once(spark, tmp_path):
    """Texts of documents meet their places without a window over them; first pairs and their number come from one search."""
    rows = [(i, f"qq {i % 3} " + "words that are said again and again by all of them " * 2, f"s{i % 2}") for i in range(40)]
    d = written(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    assert exchanges(catalog.top_duplicates(spark, d)).count("MapInArrow") == 1
    top = catalog.top_duplicates(spark, d).collect()
    every = catalog.cross_speaker_duplicates(spark, d).orderBy("start", "recording", "distance", "i").collect()
    assert len(top) == 10 and [(r["i"], r["j"], r["shared_chars"]) for r in top] == [(r["i"], r["j"], r["shared_chars"]) for r in every[:10]]
    assert {r["n_more"] for r in top} == {len(every) - 10}
    merged = turns(spark, [(f"S{i % 2}", i, i + 1, rows[i][1]) for i in range(4)]).withColumn("_origin", F.lit("a_kept"))
    assert "Join" not in exchanges(reports.cross_speaker_origins(merged))
    assert reports.cross_speaker_origins(merged).collect()[0]["origins"] == "a_kept + a_kept"
