"""Words are numbered inside their rows, whatever rows lack."""

from tests.test_catalog import written
from turnweave.plans import catalog
from turnweave.sources import speech


def test_flattening_sends_nothing(spark):
    word = lambda w: (w, 0.0, 1.0, 0.5)
    rows = [("r", [(0.0, 1.0, "a b", [word("a"), word("b")]), (0.0, 1.0, "", []), (0.0, 1.0, "", None), None, (1.0, 2.0, "c", [word("c")])]), ("s", []), ("t", None), ("u", [(0.0, 1.0, "d", [word("d")])])]
    kind = "recording string, segments array<struct<start double, end double, text string, words array<struct<word string, start double, end double, probability double>>>>"
    flat = speech.flatten_words(spark.createDataFrame(rows, kind))
    assert sorted((r["recording"], r["word_idx"], r["word"]) for r in flat.collect()) == [("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c"), ("u", 0, "d")]
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_words_of_turns(spark, tmp_path):
    texts = ["one two  three", " ", None, "four\tfive", "six " * 20]
    d = written(spark, tmp_path, "conversations", [(c, i, "x", t) for c in (1, 2) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    got = sorted(tuple(r) for r in catalog.word_flatten(spark, d).collect())
    want = []
    for c in (1, 2):
        index = at = 0
        for t in texts:
            inside = 0
            for w in (t or "").split():
                s = at + 6 * inside
                want.append((c, index, w, s / 100, (s if index % 13 == 0 else s + 6 * len(w)) / 100))
                inside, index = inside + len(w) + 1, index + 1
            at += 6 * len(t or "")
    assert got == want
