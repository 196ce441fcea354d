import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import listed, many, turns
from turnweave import schemas
from turnweave.operators import match, merge, offset, reports
from turnweave.plans import pipelines
from turnweave.sources import capture, markdown, wav


def voices(spark, angles, name):
    rows = [("m", i, f"{name}{i}", [float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))]) for i, x in enumerate(angles)]
    return spark.createDataFrame(rows, "meeting string, label_idx long, speaker string, embedding array<double>")


def matched(spark, a, b):
    return listed(match.match_speakers(voices(spark, a, "A"), voices(spark, b, "B")), "speaker_a", "speaker_b", order=("speaker_a",))


def test_match(spark):
    assert matched(spark, [0, 90, 200], [92, 2, 198]) == [("A0", "B1"), ("A1", "B0"), ("A2", "B2")]
    assert matched(spark, [0, 10, 160], [5, 160, 350]) == [("A0", "B2"), ("A1", "B0"), ("A2", "B1")]
    with pytest.raises(Exception, match="speaker counts differ"):
        matched(spark, [0, 1], [0, 1, 2])
    zero = spark.createDataFrame([("m", 0, "B0", [1.0, 0.0]), ("m", 1, "B1", [0.0, 0.0])], "meeting string, label_idx long, speaker string, embedding array<double>")
    with pytest.raises(Exception, match="B1"):
        match.match_speakers(voices(spark, [0, 90], "A"), zero).collect()


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(40):
            cost = rng.random((n, n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(cost[np.arange(n), match.assign(cost)].sum() - best) < 1e-12


def shifted(spark, rows, seconds, mapping=(("S", "P"),)):
    off = spark.createDataFrame([("r", float(seconds))], "recording string, offset_s double")
    to = spark.createDataFrame([("r", *m) for m in mapping], "recording string, speaker string, to_speaker string")
    return listed(merge.shift_and_remap(turns(spark, rows), off, to), "speaker", "start", "end")


def test_shift(spark):
    assert shifted(spark, [("S", 1, 2, "x")], 10) == [("P", 11, 12)]
    assert shifted(spark, [("S", 0, 3, "x"), ("S", 4, 6, "y"), ("S", 10, 12, "z"), ("S", 0, 5, "edge")], -5) == [("P", 0, 1), ("P", 5, 7)]
    with pytest.raises(Exception, match="no match for speaker"):
        shifted(spark, [("T", 1, 2, "x")], 0)


def fused(spark, a, b, **options):
    return listed(merge.merge_turns(turns(spark, a), turns(spark, b), **options), "speaker", "start", "end", "text", "_origin")


def test_merge_basic(spark):
    a = [("A0", 0, 5, "a0", 0.5), ("A1", 5, 10, "a1", 0.3)]
    b = [("A1", 5.2, 9.8, "b1", 0.9), ("A0", 0, 5, "b0", 0.2), ("A2", 20, 21, "b2", 0.8)]
    assert fused(spark, a, b) == [("A0", 0, 5, "a0", "a_kept"), ("A1", 5.2, 9.8, "b1", "a_replaced"), ("A2", 20, 21, "b2", "b_gapfill")]


def test_merge_once_ties_and_order(spark):
    a = [("S", 0, 5, "x", 0.1), ("S", 5, 10, "y", 0.1)]
    assert [r[3] for r in fused(spark, a, [("S", 0, 10, "b", 0.9)])] == ["b", "y"]
    assert [r[3] for r in fused(spark, [("S", 0, 5, "a", 0.5)], [("S", 0, 5, "b", 0.5)])] == ["a"]
    assert [r[3] for r in fused(spark, [("S", 100, 101, "late"), ("S", 7, 8, "a7")], [("T", 10, 11, "b10"), ("T", 7, 8, "b7")])] == ["a7", "b7", "b10", "late"]


LONG = "put the kettle on before the guests get here tonight"


@pytest.mark.parametrize(
    ("sibling", "dropped"),
    [
        (("S", 2.2, 3, "before the guests get"), True),
        (("T", 2.2, 3, "before the guests get"), False),
        (("S", 2.2, 3, "the kettle on"), False),
        (("S", 2.2, 3, "before the guest gets it"), False),
        (("S", 30, 31, "before the guests get"), False),
    ],
)
def test_containment(spark, sibling, dropped):
    a = [("S", 0, 2, "put the", 0.2), (*sibling, 0.95)]
    texts = [r[3] for r in fused(spark, a, [("S", 0, 60 if sibling[1] == 30 else 4, LONG, 0.9)])]
    assert (sibling[3] not in texts) == dropped and LONG in texts


def test_containment_radius_gap_and_direction(spark):
    far = [("S", 0, 2, "put the", 0.2), *[("T", 2, 3, "no")] * 2, ("S", 2.2, 3, "before the guests get", 0.95)]
    assert "before the guests get" in [r[3] for r in fused(spark, far, [("S", 0, 4, LONG, 0.9)])]
    assert "before the guests get" not in [r[3] for r in fused(spark, far, [("S", 0, 4, LONG, 0.9)], containment_radius=3)]
    inside = [("S", 0, 2, "x", 0.2), ("S", 2.2, 3, LONG + " and more", 0.95)]
    assert LONG + " and more" in [r[3] for r in fused(spark, inside, [("S", 0, 4, LONG, 0.9)])]


def test_gap_fill(spark):
    assert "b" in [r[3] for r in fused(spark, [("S", 0, 5, "a", 0.9)], [("S", 4.9, 30, "b", 0.1)])]
    assert "b" not in [r[3] for r in fused(spark, [("S", 0, 10, "a", 0.9)], [("S", 0.2, 9.8, "b", 0.1)])]
    assert "b" in [r[3] for r in fused(spark, [("S", 0, 10, "a", 0.9)], [("T", 0.2, 9.8, "b", 0.1)])]
    assert "b" not in [r[3] for r in fused(spark, [("S", 0, 5, "a", 0.9)], [("S", 0, 10, "b", 0.1)])]  # half is enough


def test_winner_that_is_little_covered_appears_twice(spark):
    a, b = [("S", 5, 5.4, "a", 0.2)], [("S", 3, 93, "b", 0.9)]
    assert [(r[1], r[2], r[3]) for r in fused(spark, a, b)] == [(3, 93, "b")] * 2
    assert len(fused(spark, a, b, dedupe_winners=True)) == 1


def plain_merge(a, b):
    """The rules one after another, on lists."""
    over = lambda x, y: max(0.0, min(x[2], y[2]) - max(x[1], y[1]))
    pick, used = {}, set()
    for i, x in enumerate(a):
        c = [j for j, y in enumerate(b) if j not in used and y[0] == x[0] and over(x, y) > 0]
        if c:
            j = max(c, key=lambda j: (b[j][4], -j))
            if b[j][4] > x[4]:
                pick[i] = j
                used.add(j)
    gone = set()
    for i, j in pick.items():
        for k in range(max(0, i - 2), min(len(a), i + 3)):
            if k != i and k not in pick and a[k][0] == a[i][0] and over(a[k], b[j]) > 0 and len(a[k][3]) >= 20 and a[k][3] in b[j][3] and max(a[k][1] - a[i][2], a[i][1] - a[k][2], 0) <= 15:
                gone.add(k)
    out = [(x[0], *(b[pick[i]][1:4] if i in pick else x[1:4])) for i, x in enumerate(a) if i not in gone]
    for y in b:
        total = sum(over(x, y) for x in a if x[0] == y[0])
        if (total / (y[2] - y[1]) if y[2] > y[1] else float(total > 0)) < 0.5:
            out.append(tuple(y[:4]))
    return [x for _, x in sorted(enumerate(out), key=lambda p: (p[1][1], p[0]))]


def test_merge_random(spark):
    rng = random.Random(11)
    words = ["alpha bravo charlie delta", "bravo charlie delta echo foxtrot", "golf", "alpha bravo charlie delta echo foxtrot golf hotel"]
    ta, tb, want = {}, {}, []
    for k in range(60):
        make = lambda n: sorted(((f"S{rng.randint(0, 1)}", s := rng.randint(0, 40) / 2, s + rng.randint(0, 16) / 2, rng.choice(words), rng.randint(1, 9) / 10) for _ in range(n)), key=lambda r: r[1])
        a, b = make(rng.randint(1, 8)), make(rng.randint(1, 8))
        ta[f"r{k:02}"], tb[f"r{k:02}"] = a, b
        want += [(f"r{k:02}", *r) for r in plain_merge(a, b)]
    assert listed(merge.merge_turns(many(spark, ta), many(spark, tb)), "recording", "speaker", "start", "end", "text") == want


def envelopes(spark, a, b, pair="p"):
    rows = [(pair, s, i, float(v)) for s, e in (("a", a), ("b", b)) for i, v in enumerate(e)]
    return spark.createDataFrame(rows, "pair_id string, side string, win_idx long, rms double")


def speechlike(n, seed):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.random(n // 5 + 1) > 0.5, 5)[:n] * rng.random(n)


def test_offset_with_hum_and_gain(spark):
    a = speechlike(600, 1)
    found = offset.offsets(offset.cross_correlation(envelopes(spark, a, a[200:280] * 0.3 + 0.5))).collect()[0]
    assert abs(found["offset_s"] - 20.0) < 0.2
    sure = offset.offsets(offset.cross_correlation(envelopes(spark, speechlike(1200, 1), speechlike(1200, 1)))).collect()[0]
    assert sure["confidence"] > 1.2 and not sure["weak"]
    unsure = offset.offsets(offset.cross_correlation(envelopes(spark, speechlike(1200, 1), speechlike(1200, 2)))).collect()[0]
    assert unsure["weak"]
    short = offset.offsets(offset.cross_correlation(envelopes(spark, speechlike(40, 1), speechlike(40, 1)))).collect()[0]
    assert short["confidence"] == 0.0


def test_correlation_is_the_direct_sum(spark):
    a, b = speechlike(50, 3), speechlike(30, 4)
    rows = offset.cross_correlation(envelopes(spark, a, b)).orderBy("lag").collect()
    want = np.correlate(a - a.mean(), b - b.mean(), "full")
    assert np.allclose([r["corr"] for r in rows], want) and rows[0]["lag"] == -29
    assert [r["overlap"] for r in rows] == np.correlate(np.ones(50), np.ones(30), "full").astype(int).tolist()


def test_wav_and_envelope(spark, tmp_path):
    wav.write_wav(str(tmp_path / "x.wav"), np.sin(np.arange(2050)), rate=1000)
    wav.register(spark)
    chunk = spark.read.format("wav").load(str(tmp_path))
    assert chunk.select("recording", "rate").collect() == [("x", 1000)]
    assert offset.rms_envelope_chunked(chunk).count() == 20


def test_wav_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wav, "CHUNK_WINDOWS", 7)
    wav.write_wav(str(tmp_path / "y.wav"), np.sin(np.arange(2050) / 9.0), rate=1000)
    rows = list(wav.WavReader(str(tmp_path)).read(wav.WavPartition(str(tmp_path / "y.wav"))))
    assert [(r[2], len(r[3])) for r in rows] == [(0, 700), (700, 700), (1400, 650)]
    chunks = spark.createDataFrame([tuple(map(lambda v: v if not isinstance(v, list) else list(v), r)) for r in rows], "recording string, rate int, start long, samples array<int>")
    whole = spark.createDataFrame([("y", 1000, [v for r in rows for v in r[3]])], "recording string, rate int, samples array<int>")
    a, b = (sorted(tuple(r) for r in offset.rms_envelope_chunked(x).collect()) for x in (chunks, whole))
    assert a == b and len(a) == 20
    with pytest.raises(Exception, match="inside a window"):
        offset.rms_envelope_chunked(chunks.withColumn("start", chunks.start + 1)).collect()


def test_wav_ranges(spark, tmp_path, monkeypatch):
    """One file in many tasks gives what one task gives, by the data source, by a table of files, and by Spark's reader."""
    monkeypatch.setattr(wav, "CHUNK_WINDOWS", 3)
    (tmp_path / "in").mkdir()
    for name, n in (("long", 5230), ("short", 250), ("none", 0)):
        wav.write_wav(str(tmp_path / "in" / f"{name}.wav"), np.sin(np.arange(n) / 7.0), rate=1000)
    whole = {}
    for size in (100_000, 11, 6):
        monkeypatch.setattr(wav, "RANGE_WINDOWS", size)
        reader = wav.WavReader(f"file://{tmp_path}/in")
        parts = reader.partitions()
        got = {}
        for p in parts:
            for name, rate, start, samples in reader.read(p):
                got.setdefault(name, []).extend(enumerate(samples, start))
        assert len([p for p in parts if "long" in p.path]) == -(-5230 // (size * 100))
        assert all([k for k, _ in x] == list(range(len(x))) for x in got.values()) and {k: len(x) for k, x in got.items()} == {"long": 5230, "short": 250}
        whole = whole or got
        assert got == whole
    files = spark.createDataFrame([("m", "a", f"file:{tmp_path}/in/long.wav"), ("m", "b", f"{tmp_path}/in/short.wav"), ("n", "a", None), ("o", "a", f"{tmp_path}/in/long.wav")], "recording string, side string, path string")
    by_table = offset.rms_envelope_chunked(wav.read_ranges(files).withColumn("recording", F.concat("recording", "side")))
    rows = {(r["recording"], r["win_idx"]): r["rms"] for r in by_table.collect()}
    for content in (wav.read_wav(spark, str(tmp_path / "in")), wav.read_wav(spark, f"file:{tmp_path}/i[n]")):
        direct = {(r["recording"], r["win_idx"]): r["rms"] for r in offset.rms_envelope_chunked(content).collect()}
        assert rows == {(k, w): v for r, keys in (("long", ("ma", "oa")), ("short", ("mb",))) for k in keys for (x, w), v in direct.items() if x == r} and len(direct) == 54


@pytest.mark.parametrize(("segment", "share"), [(7, 1), (16, 2), (4096, 64)])
def test_correlation_in_segments(spark, monkeypatch, segment, share):
    monkeypatch.setattr(offset, "SHARE", share)
    rng = np.random.default_rng(segment)
    sizes = {"p": (50, 31), "q": (3, 40), "r": (1, 1), "s": (33, 33)}
    sides = {k: (rng.uniform(0, 9, m), rng.uniform(0, 9, n)) for k, (m, n) in sizes.items()}
    rows = [(k, s, i, float(v)) for k, x in sides.items() for s, side in zip("ab", x, strict=True) for i, v in enumerate(side)]
    e = spark.createDataFrame([*rows, ("alone", "a", 0, 1.0)], "pair_id string, side string, win_idx long, rms double")
    for center in (True, False):
        got = {}
        for r in offset.cross_correlation(e, center, segment).collect():
            got.setdefault(r["pair_id"], {})[r["lag"]] = r
        assert list(got.pop("alone")) == [None] and set(got) == set(sizes)
        for k, (a, b) in sides.items():
            x, y = (v - v.mean() if center else v for v in (a, b))
            want = dict(zip(range(1 - len(b), len(a)), np.correlate(x, y, "full"), strict=True))
            assert set(got[k]) == set(want) and all(np.isclose(got[k][lag]["corr"], v, atol=1e-9) for lag, v in want.items())
            assert all(r["overlap"] == min(len(a), lag + len(b)) - max(0, lag) and r["n_min"] == min(sizes[k]) for lag, r in got[k].items())


def test_fingerprints_of_multisets(spark):
    t = turns(spark, [("S", 0, 1, "a"), ("S", 1, 2, "b"), ("T", 1, 2, "b")])
    same = reports.multiset_fingerprint(t.unionByName(t.limit(0)).orderBy(F.desc("turn_idx")))
    assert same == reports.multiset_fingerprint(t) and same[0] == 3
    others = [t.unionByName(t.limit(1)), t.withColumn("text", F.when(F.col("turn_idx") != 1, F.col("text"))), t.withColumn("text", F.lit("b")), t.limit(0)]
    assert len({same, *map(reports.multiset_fingerprint, others)}) == 5


def test_controls_and_metrics(spark):
    a, b = speechlike(300, 1), speechlike(260, 1)
    e = envelopes(spark, a, b)
    got = {r["pair_id"].partition("/")[2]: r for r in offset.control_report(e).collect()}
    assert set(got) == {"", "first half, second half", "second half, first half", "shuffled", "reversed", "noise"}

    def plain(x, y):
        corr = np.correlate(x, y, "full")
        at = int(np.argmax(corr))
        far = np.delete(corr, np.arange(max(0, at - 50), min(len(corr), at + 51)))
        return (at - len(y) + 1) * 0.1, corr.max() / far.max(), corr.max() / np.median(corr), corr.min(), corr.max(), np.median(corr), corr.std()

    for kind, x, y in (("", a, b), ("first half, second half", a[:150], b[130:]), ("second half, first half", a[150:], b[:130]), ("reversed", a, b[::-1])):
        assert np.allclose([got[kind][c] for c in ("offset_s", "peak_over_rival", "peak_over_median", "least", "most", "median", "deviation")], plain(x, y)), kind
    controls = offset.add_null_controls(e).where("side = 'b'").orderBy("win_idx").toPandas()
    mixed, noise = (controls[controls.pair_id == f"p/{k}"].rms.to_numpy() for k in ("shuffled", "noise"))
    assert sorted(mixed) == sorted(b) and list(mixed) != list(b)
    assert len(noise) == 260 and 0.5 < np.sqrt((noise**2).mean()) / b.std() < 1.5
    apart = offset.separation(offset.control_report(e)).collect()[0]
    nulls = [got[k]["peak_over_rival"] for k in got if k]
    assert np.allclose([apart[c] for c in ("true", "null_min", "null_median", "null_max")], [got[""]["peak_over_rival"], min(nulls), np.median(nulls), max(nulls)])
    assert np.isclose(apart["separation"], apart["true"] / max(nulls)) and np.isclose(apart["midpoint"], (apart["true"] + max(nulls)) / 2)


def test_a_short_pair_stops_no_other(spark):
    e = envelopes(spark, speechlike(600, 1), speechlike(600, 1)[100:400]).unionByName(envelopes(spark, speechlike(60, 1), [], "short"))
    got = {r["pair_id"]: r for r in offset.offsets(offset.cross_correlation(e)).collect()}
    assert abs(got["p"]["offset_s"] - 10) < 0.2 and got["p"]["error"] is None
    assert got["short"]["offset_s"] is None and "too short" in got["short"]["error"]
    with pytest.raises(Exception, match="too short"):
        offset.find_offset(e).collect()


def test_a_recording_without_an_offset_fails(spark):
    b, none = turns(spark, [("x", 0, 1, "t")]), spark.createDataFrame([], "recording string, offset_s double")
    with pytest.raises(Exception, match="no offset for r"):
        merge.shift_and_remap(b, none, spark.createDataFrame([("r", "x", "y")], "recording string, speaker string, to_speaker string")).collect()


def test_reports(spark):
    a = [("S", 0, 2, "put the", 0.2), ("S", 2.2, 3, "before the guests get", 0.95), ("T", 2.2, 3, "kettle", 0.95), ("S", 3, 3.5, "...", 0.95)]
    b = [("S", 0, 4, LONG, 0.9)]
    sweep = {(r["radius"], r["min_chars"]): (r["same_fires"], r["cross_fires"], r["chars"]) for r in reports.guard_sweep(turns(spark, a), turns(spark, b)).collect()}
    assert len(sweep) == 16 and sweep[2, 20] == (1, 0, 21) and sweep[2, 40] == (0, 0, 0) and sweep[1, 0] == (1, 0, 21) and sweep[2, 0] == (1, 1, 21)
    lost = reports.guard_losses(turns(spark, a), turns(spark, b)).collect()
    assert {r["word"] for r in lost} == {"before", "the", "guests", "get"} and not any(r["lost"] for r in lost)


def test_instruments_agree_with_production(spark):
    a = turns(spark, [("S", 0, 2, "put the", 0.2), ("T", 3, 4, "hello", 0.9)])
    b = turns(spark, [("S", 0, 4, LONG, 0.9)])
    merged = merge.merge_turns(a, b)
    reports.assert_same_turns(merged, merge.merge_turns(a, b).drop("_origin", "_a_idx", "_b_idx"))
    with pytest.raises(AssertionError, match="disagrees"):
        reports.assert_same_turns(merged.unionByName(merged.limit(1)), merged)


def test_origins_and_timing_of_pairs(spark):
    a = [("S", 0, 4, LONG, 0.5), ("T", 10, 14, "nothing like that", 0.5)]
    b = [("T", 3, 6, LONG, 0.4), ("S", 20, 24, LONG + " again", 0.4), ("U", 30, 33, LONG, 0.4)]
    merged = merge.merge_turns(turns(spark, a), turns(spark, b))
    assert {r["origins"]: r["n"] for r in reports.cross_speaker_origins(merged).collect()} == {"a_kept + b_gapfill": 2, "b_gapfill + b_gapfill": 3}
    assert [tuple(r) for r in reports.cross_speaker_timing(merged).collect()] == [(1, 4)]


def test_vocabulary_reports(spark):
    rows = [("S", k, k + 1, t) for k, t in enumerate(["zonk zonk the yeah"] * 30 + ["...", "mm-hmm", "mm-hmm!", "no", "Zonk", "b a", "a b"])]
    t = turns(spark, rows)
    top = [tuple(r) for r in reports.dominant_tokens(t, 4).collect()]
    total = 30 * 4 + 1 + 1 + 1 + 1 + 1 + 4
    assert [(w, n) for w, n, _ in top] == [("zonk", 61), ("the", 30), ("yeah", 30), ("mm-hmm", 2)] and np.isclose(top[0][2], 61 / total)
    assert [tuple(r) for r in reports.suspicious_tokens(t, over=20).collect()] == [("zonk", 61)] and len(reports.COMMON) == len(set(reports.COMMON))
    short = {(r["backchannel"], r["place"]): (r["token"], r["n"]) for r in reports.top_short_texts(t).collect()}
    assert short == {(True, 1): ("mm-hmm", 2), (True, 2): ("no", 1), (False, 1): ("", 1), (False, 2): ("zonk", 1), (False, 3): ("ba", 1), (False, 4): ("ab", 1)}
    runs = turns(spark, [("S", 0, 1, "a. a, a a b"), ("S", 1, 2, "a a a b a"), ("S", 2, 3, "- - . . ! !"), ("S", 3, 4, "aa a a a"), ("S", 4, 5, "")])
    assert [r["turn_idx"] for r in reports.degeneration_within(runs).collect()] == [0]


def fusion_tables(spark):
    """Two meetings; the second recording of each hears its middle, quieter and with a hum."""
    rng = np.random.default_rng(15)
    sounds, t = [], {k: [] for k in ("words_a", "words_b", "diarization_a", "diarization_b", "embeddings_a", "embeddings_b")}
    for m, first in (("kitchen", 12), ("garden", 31)):
        sound = np.repeat(rng.random(140) > 0.4, 500) * rng.normal(size=70_000)
        sounds += [(m, "a", 1000, sound.tolist()), (m, "b", 1000, (sound[first * 1000 : (first + 12) * 1000] * 0.4 + 0.3).tolist())]
        said = [("one", 0, "low"), ("two", 1, "low"), ("three", 5, "high"), ("four", 6, "high")]
        t["words_a"] += [(m, i, f" {w}?", first + s + 0.0, first + s + 0.5, 0.2) for i, (w, s, _) in enumerate(said)]
        t["words_b"] += [(m, i, f" {w}", s + 0.0, s + 0.5, 0.9) for i, (w, s, _) in enumerate(said)]
        t["diarization_a"] += [(m, 0, first + 0.0, first + 2.0, "v1"), (m, 1, first + 5.0, first + 7.0, "v2")]
        t["diarization_b"] += [(m, 0, 0.0, 2.0, "q9"), (m, 1, 5.0, 7.0, "q3")]
        t["embeddings_a"] += [(m, 0, "v1", [0.8, 0.6]), (m, 1, "v2", [-0.6, 0.8])]
        t["embeddings_b"] += [(m, 0, "q3", [-0.55, 0.83]), (m, 1, "q9", [0.83, 0.55])]
    kinds = {"words": schemas.WORDS, "diarization": schemas.DIARIZATION, "embeddings": schemas.EMBEDDINGS}
    tables = {k: spark.createDataFrame(v, kinds[k.split("_")[0]]) for k, v in t.items()}
    return tables, spark.createDataFrame(sounds, "recording string, side string, rate int, samples array<double>")


def test_fusion_end_to_end(spark, tmp_path):
    tables, sounds = fusion_tables(spark)
    mute = spark.createDataFrame([("cellar", 0, "word", 0.0, 1.0, 0.5)], schemas.WORDS)
    tables["words_a"] = tables["words_a"].unionByName(mute)
    short = spark.createDataFrame([("attic", "a", 1000, [0.1] * 5000), ("attic", "b", 1000, [0.1] * 50)], sounds.schema)
    capture.write_capture(str(tmp_path / "capture"), tables)
    envelopes_of = pipelines.envelopes(sounds.unionByName(short))
    assert envelopes_of.where("pair_id = 'attic' and side = 'b'").count() == 0
    fused = pipelines.fuse(capture.read_capture(spark, str(tmp_path / "capture")), envelopes_of)
    offsets = {r["pair_id"]: r["offset_s"] for r in fused.offsets.collect()}
    assert abs(offsets["kitchen"] - 12) < 0.15 and abs(offsets["garden"] - 31) < 0.15 and offsets["attic"] is offsets["cellar"] is None
    texts = {r["recording"]: r["markdown"] for r in fused.markdown.collect()}
    assert texts["kitchen"] == "## Person 1 — 00:12\n\none two\n\n## Person 2 — 00:17\n\nthree four\n"
    assert texts["garden"] == texts["kitchen"].replace("00:12", "00:31").replace("00:17", "00:36") and set(texts) == {"kitchen", "garden"}
    assert [(r["recording"], r["severity"]) for r in fused.diagnostics.where("kind = 'offset' and severity = 'error'").orderBy("recording").collect()] == [("attic", "error"), ("cellar", "error")]
    assert any("too short" in line for line in pipelines.shown(fused.diagnostics))
    assert markdown.write_transcripts(fused.markdown, str(tmp_path / "out"), suffix=".fused.md", allow_empty=True) == []
    assert (tmp_path / "out" / "garden.fused.md").read_text(encoding="utf-8") == texts["garden"]
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if f.suffix == ".md") == ["garden.fused.md", "kitchen.fused.md"]
    assert markdown.read_transcripts(spark, str(tmp_path / "out")).count() == 4
    single = pipelines.transcribe_recordings(tables["words_a"].where("recording = 'kitchen'"), tables["diarization_a"])
    assert "one? two?" in {r["recording"]: r["markdown"] for r in single.markdown.collect()}["kitchen"]


def test_captures_are_rendered_with_and_without_the_guard(spark):
    a = [("v1", 0, 2, "put the", 0.2), ("v1", 2.2, 3, "before the guests get", 0.95)]
    t = {"turns_a": turns(spark, a, "m"), "turns_b": turns(spark, [("q", 5, 9, LONG, 0.9)], "m"), "offsets": spark.createDataFrame([("m", -5.0)], "recording string, offset_s double")}
    t |= {f"embeddings_{s}": spark.createDataFrame([("m", 0, n, [1.0, 0.1])], schemas.EMBEDDINGS) for s, n in (("a", "v1"), ("b", "q"))}
    with_guard, without = (pipelines.render_capture(t, guard).collect()[0]["markdown"] for guard in (True, False))
    assert with_guard.count("## Person 1") == 1 and without.count("## Person 1") == 2 and "before the guests get\n" in without
    with pytest.raises(ValueError, match="lacks"):
        pipelines.render_capture({"turns_a": t["turns_a"]})


def test_long_lists_of_warnings_say_how_many_more(spark):
    rows = [("r", "loop", "warning", f"m{k:02}", float(k)) for k in range(13)] + [("r", "offset", "info", "fine", None)]
    lines = pipelines.shown(spark.createDataFrame(rows, "recording string, kind string, severity string, message string, start double"))
    assert lines[:10] == [f"warning: r: m{k:02}" for k in range(10)] and lines[10:] == ["  ... and 3 more", "info: r: fine"]


def test_plans_do_not_pair_all_turns(spark):
    """Turns of one speaker that are far apart never meet."""
    many_turns = [("S", 100 * k, 100 * k + 3, f"t{k}", 0.5) for k in range(300)]
    a, b = turns(spark, many_turns), turns(spark, [(s, x + 1, y + 1, t, 0.6) for s, x, y, t, _ in many_turns])
    met = merge.same_speaker_overlaps(a, b)
    assert met.count() == 300
    join = [line for line in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert join and all("_cell" in line for line in join)


def test_capture_needs_a_folder(monkeypatch):
    monkeypatch.delenv("TURNWEAVE_CAPTURE", raising=False)
    with pytest.raises(FileNotFoundError, match="write_capture"):
        capture.capture_folder()
