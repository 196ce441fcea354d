import random

from pyspark.sql import functions as F

from turnweave.functions import text as t
from turnweave.sources import media


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


ODD = ["", " a  b ", "a b c", "\u001fx\u0085y　", "one\ttwo\nthree", "  "]


def test_words_and_strip_follow_unicode_space(spark):
    assert values(spark, ODD, t.words) == [x.split() for x in ODD]
    assert values(spark, ODD, t.strip) == [x.strip() for x in ODD]


def test_stamp(spark):
    df = spark.createDataFrame([(3.0,), (102.0,), (3725.0,), (-2.5,), (400_000.0,)], "s double")
    assert [r[0] for r in df.select(t.stamp(F.col("s"))).collect()] == ["00:03", "01:42", "01:02:05", "00:00", "111:06:40"]
    assert values(spark, ["00:03", "01:02:05"], t.stamp_seconds) == [3, 3725]


def test_token_and_normalisers_differ(spark):
    assert values(spark, ["Lars.", '"Lars"', "Lars'", "l.a"], t.loop_token) == ["lars", "lars", "lars", "l.a"]
    assert values(spark, [" A,  b\nC "], t.containment_text) == ["a bc"]
    assert values(spark, [" A,  b\nC "], t.duplicate_text) == [" a  bc "]
    assert values(spark, [" A,b\nC "], t.bag_words) == [["a", "b", "c"]]


def test_backchannels(spark):
    rows = ["Yeah yeah", "mm-hmm", "No, no.", "yeah the", "", "..."]
    assert values(spark, rows, t.is_backchannel) == [True, True, True, False, False, False]
    assert values(spark, ["Yeah yeah", "mm-hmm"], t.is_backchannel_squashed) == [False, True]


def test_spans(spark):
    df = spark.createDataFrame([(0.0, 5.0, 4.0, 9.0), (0.0, 1.0, 3.0, 4.0)], "a double, b double, c double, d double")
    row = df.select(t.overlap_seconds(F.col("a"), F.col("b"), F.col("c"), F.col("d")), t.gap_seconds(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()
    assert [tuple(r) for r in row] == [(1.0, 0.0), (0.0, 2.0)]


def test_media_names(spark, tmp_path, monkeypatch):
    assert values(spark, ["/x/a.M4A", "/x/b.txt", "/x.mp3/c"], media.is_media) == [True, False, False]
    assert values(spark, ["/x/a.b.mp3", "plain", "/x/.env"], t.stem) == ["a.b", "plain", ".env"]
    (tmp_path / "sub").mkdir()
    for name in ("b.mp3", "a.WAV", "c.txt", "sub/d.mp3"):
        (tmp_path / name).write_bytes(b"x")
    found = [r["path"].rsplit("/", 1)[1] for r in media.scan_media(spark, str(tmp_path)).collect()]
    assert found == ["a.WAV", "b.mp3"]
    assert media.scan_media(spark, "/nowhere/x.mp3").collect()[0]["path"] == "/nowhere/x.mp3"
    monkeypatch.chdir(tmp_path)
    assert media.scan_media(spark).count() == 0
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "e.flac").write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in media.scan_media(spark).collect()] == ["e.flac"]


def test_commands_and_names(monkeypatch, tmp_path):
    assert media.audio_filter(True) == "highpass=f=80,afftdn=nf=-25,loudnorm=I=-16:TP=-1.5:LRA=11"
    command = media.extraction_command("in.m4a", "out.wav", None)
    assert "-af" not in command and command[-1] == "out.wav" and command[command.index("-ar") + 1] == "16000"
    assert media.resolve_model("a/b") == "a/b" and media.resolve_model("other") == "other" and "/" in media.resolve_model("turbo")
    monkeypatch.delenv("HF_TOKEN", raising=False)
    (tmp_path / ".env").write_text("HF_TOKEN='abc'\n")
    assert media.resolve_token(folders=(str(tmp_path),)) == "abc"
    monkeypatch.setenv("HF_TOKEN", "env")
    assert media.resolve_token(folders=(str(tmp_path),)) == "env"


def test_words_match_python_on_random_text(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("ab \t\n  \u001c\u0085.") for _ in range(20)) for _ in range(200)]
    assert values(spark, rows, t.words) == [x.split() for x in rows]


def test_speaking_rate(spark):
    df = spark.createDataFrame([("one two  three", 1.0, 3.0), ("", 0.0, 2.0), ("x", 2.0, 2.0)], "text string, a double, b double")
    assert [r[0] for r in df.select(t.words_per_second(F.col("text"), F.col("a"), F.col("b"))).collect()] == [1.5, 0.0, None]
