"""What each rule of the smoothing leaves alone, and the turns left to judge; every fixture says something."""

from tests.helpers import listed, turns
from turnweave.operators import reports

TALK = [
    ("S", 0, 5, "we went to the shore on the first day", 0.9),
    ("T", 5, 5, "the", 0.3),  # eligible
    ("S", 5, 9, "and came back", 0.8),
    ("T", 9, 9, "Yeah, ok.", 0.3),  # kept by the word list
    ("S", 9, 12, "late", 0.8),
    ("T", 12, 13, "Yeah.", 0.3),  # lasts, and is listed: by its duration
    ("S", 13, 14, "so", 0.8),
    ("T", 14, 14.5, "no way", 0.3),  # lasts
    ("S", 15, 16, "then", 0.8),
    ("T", 16, 16, "one two three", 0.3),  # not short
    ("S", 16, 18, "home", 0.8),
    ("U", 18, 18, "x", 0.3),  # between two speakers
    ("T", 18, 19, "bye", 0.8),
]


def test_what_the_rules_of_smoothing_leave(spark):
    got = reports.smoothing_exclusions(turns(spark, TALK))
    # places 1, 3, 4, 5, 6, 7 and 8 are short and stand between two turns of one other speaker; 4 to 8 last
    assert listed(got, "short", "by_duration", "by_word_list", "words_listed") == [(7, 5, 1, "Yeah, ok. 1")]
    assert reports.smoothing_exclusions(turns(spark, [])).count() == 0
    assert reports.smoothing_exclusions(turns(spark, TALK[:2])).count() == 0


def test_candidates_with_what_is_around_them(spark):
    found = reports.smoothing_candidates(turns(spark, TALK), chars=9)
    assert listed(found, "turn_idx", "speaker", "start", "text", "into", "before", "after") == [(1, "T", 5.0, "the", "S", "first day", "and came ")]
    looped = [("S", 0, 5, "go", 0.9), ("T", 5, 5, "go", 0.3), ("S", 5, 9, "go", 0.8)]
    assert reports.smoothing_candidates(turns(spark, looped), threshold=4).count() == 1
    assert reports.smoothing_candidates(turns(spark, looped), threshold=3).count() == 0


def test_fixtures_hold_what_the_reports_count(spark):
    from turnweave.plans import catalog

    sf = "/root/testdata/sf0.001"
    assert {r["origins"] for r in catalog.cross_speaker_origins(spark, sf).collect()} >= {"a_kept + a_kept", "a_kept + a_replaced"}
    timing = catalog.cross_speaker_timing(spark, sf).first()
    assert timing["same_time"] > 0
    assert all(r["by_duration"] > 0 for r in catalog.smoothing_exclusions(spark, sf).limit(3).collect())
