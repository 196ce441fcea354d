"""What a merge does with texts grows with neighbours that overlap, and not with all turns of both recordings."""

from pyspark.sql import functions as F

from tests.helpers import listed, turns
from turnweave.functions.text import containment_text
from turnweave.operators import merge, reports
from turnweave.plans import catalog

A = [
    ("S", 0, 2, "We went home", 0.4),
    ("S", 2, 6, "early,  in the morning — of THAT day", 0.3),  # its words are in the turn that replaces the first
    ("T", 4, 5, "in the morning", 0.9),  # so are these, of another speaker
    ("S", 6, 9, "early in the morning of that day", 0.9),  # no part of its time
    ("S", 100, 110, "far from all the others in this talk", 0.9),
]
B = [("S", 0, 6, "we went home: early in the morning, of that day.", 0.8)]


def test_only_neighbours_that_overlap_are_normalised(spark):
    a, b = turns(spark, A), turns(spark, B)
    picks = merge.replacements(a, b)
    consumed = merge.consumed_siblings(a, b, picks)
    assert listed(consumed, "turn_idx") == [(1,)]
    asked = [line for line in consumed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "regexp_replace" in line]
    assert asked and all("Join " in line for line in asked), asked
    assert listed(reports.guard_fires(a, b, picks), "turn_idx", "step", "same_speaker", "chars") == [(1, 1, True, 32), (2, 2, False, 14)]
    assert listed(merge.consumed_siblings(a, b, picks, min_chars=33), "turn_idx") == []


def test_spaces_of_containment(spark):
    texts = ["  a \t b\n\nc ", "A--B  -  c", "é 中 x", "", " ", None, "one two"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", containment_text(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == ["a bc", "ab c", "x", "", "", None, "one two"]


def test_merge_reports_read_both_sides_from_what_was_written(spark):
    found = catalog.cross_speaker_timing(spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("turnweave-" in path for path in found.inputFiles())
