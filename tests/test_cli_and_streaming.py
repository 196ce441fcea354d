import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import turns
from turnweave import cli
from turnweave.operators.turns import relabel_speakers
from turnweave.sources import capture, markdown, media, speech, wav
from turnweave.streaming import each_batch


def test_transcripts_from_stored_results(spark, tmp_path, capsys):
    (tmp_path / "asr").mkdir()
    (tmp_path / "dia").mkdir()
    word = lambda w, a: {"word": " " + w, "start": a, "end": a + 0.5, "probability": 0.9}
    (tmp_path / "asr/meeting.json").write_text(json.dumps({"segments": [{"start": 0, "end": 2, "text": "hi you", "words": [word("hi", 0.0), word("you", 1.2)]}]}))
    (tmp_path / "dia/meeting.json").write_text(json.dumps({"tracks": [{"start": 1, "end": 2, "label": "B"}, {"start": 0, "end": 1, "label": "A"}], "labels": ["A", "B"], "embeddings": [[1.0], [0.5]]}))
    assert cli.main(["--asr", str(tmp_path / "asr"), "--diarization", str(tmp_path / "dia"), "--output-dir", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/meeting.md").read_text() == "## Person 1 — 00:00\n\nhi\n\n## Person 2 — 00:01\n\nyou\n"
    assert cli.main([str(tmp_path)]) == 1 and "no recogniser" in capsys.readouterr().err
    (tmp_path / "asr/silent.json").write_text(json.dumps({"segments": []}))
    (tmp_path / "dia/silent.json").write_text(json.dumps({"tracks": [], "labels": [], "embeddings": []}))
    assert cli.main(["--asr", str(tmp_path / "asr"), "--diarization", str(tmp_path / "dia"), "--output-dir", str(tmp_path / "out")]) == 1
    assert "silent: no speech found" in capsys.readouterr().err and not (tmp_path / "out/silent.md").exists()
    assert cli.main(["--fuse-capture", str(tmp_path / "none"), "--sounds", "x"]) == 1


def test_options_of_models_need_models(tmp_path, capsys):
    for option in (["--model", "x"], ["--language", "de"], ["--prompt", "p"], ["--verbose"]):
        assert cli.main([*option, "--asr", str(tmp_path), "--diarization", str(tmp_path)]) == 1
        assert "only a recogniser uses this" in capsys.readouterr().err
    assert cli.main(["--recogniser", "a:b"]) == 1 and "go together" in capsys.readouterr().err


def test_media_through_adapters(spark, tmp_path, capsys, monkeypatch):
    """Every recording that fails is named, the others are written."""
    monkeypatch.setattr(media, "extract_audio", lambda files, folder, filters=None: files.select("path", F.col("path").alias("cleaned"), F.lit(None).cast("string").alias("error")))
    (tmp_path / "in").mkdir()
    for name in ("fine.mp3", "broken.wav", "quiet.m4a", "alone.mp4", "notes.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    options = ["--recogniser", "tests.adapters:recogniser", "--diarizer", "tests.adapters:diarizer", "--model", "some/model", "--language", "fr", "--prompt", "names", "--verbose", "--num-speakers", "3", "--output-dir", str(tmp_path / "out")]
    assert cli.main([str(tmp_path / "in"), *options]) == 1
    out, err = capsys.readouterr()
    assert (tmp_path / "out" / "fine.md").read_text(encoding="utf-8") == "## Person 1 — 00:00\n\nhello\n\n## Person 2 — 00:02\n\nyou\n"
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if f.suffix == ".md") == ["fine.md"]
    assert "broken: OSError: unreadable" in err and "quiet: no speech found" in err and "alone: no speaker turns" in err
    assert "fine: asked for 3 speakers, found 2" in err and "Done. 1/4" in out
    assert cli.main([str(tmp_path / "in" / "none.mp3"), *options]) == 1 and "no such file" in capsys.readouterr().err
    (tmp_path / "empty").mkdir()
    assert cli.main([str(tmp_path / "empty"), *options]) == 1 and "no media files" in capsys.readouterr().err


def two_recordings(folder):
    """A meeting heard by two machines: the second starts nine seconds later, quieter."""
    rng = np.random.default_rng(8)
    sound = np.repeat(rng.random(120) > 0.5, 500) * rng.normal(size=60_000)
    wav.write_wav(str(folder / "desk.wav"), sound, 1000)
    wav.write_wav(str(folder / "phone.wav"), sound[9_000:45_000] + rng.normal(0, 0.05, 36_000), 1000)


def as_it_is(files, folder, filters=None):
    return files.select("path", F.col("path").alias("cleaned"), F.lit(None).cast("string").alias("error"))


def test_two_media_files_are_fused(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(media, "extract_audio", as_it_is)
    monkeypatch.setenv("HF_TOKEN", "let me in")
    two_recordings(tmp_path)
    desk, phone, out, kept = (str(tmp_path / x) for x in ("desk.wav", "phone.wav", "out", "kept"))
    models = ["--recogniser", "tests.adapters:two_machines", "--diarizer", "tests.adapters:voices_with_token", "--output-dir", out]
    assert cli.main([desk, "--fuse", phone, "--capture", kept, "--num-speakers", "3", *models]) == 0
    said, err = capsys.readouterr()
    text = (tmp_path / "out" / "desk.fused.md").read_text(encoding="utf-8")
    assert text == "## Person 1 — 00:11\n\nclear speech\n\n## Person 2 — 00:20\n\nonly here\n\n## Person 1 — 00:30\n\nlater\n"
    assert "desk.fused.md" in said and "offset +9.0 s" in err and "found 2 on side a" in err and "found 2 on side b" in err
    tables = capture.read_capture(spark, kept)
    assert set(tables) == set(capture.TABLES) and [r["text"] for r in tables["turns_b"].orderBy("turn_idx").collect()] == ["clear speech", "on", "later"]
    assert cli.main(["--render-capture", kept, "--output-dir", str(tmp_path / "again")]) == 0
    assert (tmp_path / "again" / "desk.fused.md").read_text(encoding="utf-8") == text
    capsys.readouterr()
    assert cli.main(["--report", f"{out}/desk.fused.md"]) == 0
    lines = capsys.readouterr().out
    assert "desk.fused: 3 blocks, 5 words; blocks of at most 1, 2, 3, 5 words: 1, 3, 3, 3; 1 between" in lines and "acknowledgements" in lines


def test_what_a_fusion_needs(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(media, "extract_audio", as_it_is)
    two_recordings(tmp_path)
    desk, phone = str(tmp_path / "desk.wav"), str(tmp_path / "phone.wav")
    models = ["--recogniser", "tests.adapters:two_machines", "--diarizer", "tests.adapters:voices_with_token", "--output-dir", str(tmp_path / "out")]
    failing = [
        ([str(tmp_path), "--fuse", phone, *models], "single media file"), (["--fuse", phone, *models], "single media file"),
        ([desk, "--fuse", phone + "x", *models], "no such file"), ([desk + "x", "--fuse", phone, *models], "no such file"),
        ([desk, "--fuse", phone], "give --recogniser"), ([desk, "--capture", "x", *models], "goes with --fuse"),
    ]
    monkeypatch.setattr(media, "resolve_token", lambda *a: None)
    for options, message in [*failing, ([desk, "--fuse", phone, *models], "no credential")]:
        assert cli.main(options) == 1 and message in capsys.readouterr().err
    monkeypatch.setattr(media, "resolve_token", lambda *a: "t")
    broken = str(tmp_path / "broken.wav")
    wav.write_wav(broken, [0.0] * 100, 1000)
    assert cli.main([desk, "--fuse", broken, *models]) == 1 and "recognition of side b: OSError: unreadable" in capsys.readouterr().err
    assert not (tmp_path / "out" / "desk.fused.md").exists()


def test_extraction_failures_are_rows(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"no sound")
    files = spark.createDataFrame([(str(tmp_path / "a.mp3"),), (str(tmp_path / "gone.mp3"),)], "path string")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in media.extract_audio(files, str(tmp_path / "clean")).collect()}
    assert rows["a.mp3"]["error"] and rows["a.mp3"]["cleaned"] is None and "no such file" in rows["gone.mp3"]["error"]


def test_diarizer_loading(capsys):
    with pytest.raises(RuntimeError, match="no credential.*looked in here"):
        speech.load_diarizer(lambda token: None, None, ("here",))

    def fails(_):
        raise OSError("disk full")

    with pytest.raises(RuntimeError, match=r"Underlying error \(OSError\): disk full"):
        speech.load_diarizer(fails, "t")
    model = speech.load_diarizer(lambda token: ("model", token), "t", move=fails)
    assert model == ("model", "t") and "stays on the CPU" in capsys.readouterr().err


def test_writing_transcripts(spark, tmp_path):
    rows = spark.createDataFrame([("a b%2F=c", "text é\n\nmore\n"), ("empty", "\n")], "recording string, markdown string")
    expected = spark.createDataFrame([("a b%2F=c",), ("empty",), ("unheard",)], "recording string")
    for _ in range(2):  # writing again overwrites
        assert markdown.write_transcripts(rows, str(tmp_path / "o"), expected=expected) == ["empty", "unheard"]
    assert [f.name for f in (tmp_path / "o").iterdir() if f.suffix == ".md"] == ["a b%2F=c.md"]
    assert (tmp_path / "o" / "a b%2F=c.md").read_text(encoding="utf-8") == "text é\n\nmore\n"
    assert markdown.write_transcripts(rows, str(tmp_path / "p"), allow_empty=True) == [] and (tmp_path / "p" / "empty.md").read_text() == "\n"
    with pytest.raises(Exception, match="not a file name"):
        markdown.write_transcripts(rows.withColumn("recording", F.lit("../x")), str(tmp_path / "q"))


def test_filter_choice():
    pick = lambda *a: cli.chosen_filter(cli.parser().parse_args(list(a)))
    assert pick() is None and "afftdn" in pick("--denoise") and "afftdn" not in pick("--preprocess") and pick("--audio-filter", "x") == "x"


def test_recordings_that_arrive(spark, tmp_path):
    for k in range(3):
        turns(spark, [("S5", 0, 1, "a"), ("S2", 1, 2, "b")], f"r{k}").write.parquet(f"{tmp_path}/in/part{k}")
    schema = spark.read.parquet(f"{tmp_path}/in/part0").schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    each_batch(stream, relabel_speakers, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 6 and {r["speaker"] for r in got.collect()} == {"Person 1", "Person 2"}
