"""Queries of the catalogue over small tables, against brute force: the whole of each table is used."""

import itertools
import random

import numpy as np

from turnweave.plans import catalog
from turnweave.sources import projections


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


def test_duplicates_of_whole_documents(spark, tmp_path):
    """Runs past place 600 count, the share is taken over whole texts, and documents in loops are left out."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    late, early, line = noise(900), noise(500), noise(33)
    texts = [noise(700) + late, noise(650) + late, early + noise(900), early + noise(900), line * 40, line * 40 + noise(50), "paul " * 30 + late, late[100:300]]
    rows = [(i, f"qq {chr(97 + i)} " + t, "s" + str(i % 3)) for i, t in enumerate(texts)]
    rows += [(20, None, "s0"), (21, "", "s1")]
    d = written(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    blocks = sorted((t[:80], i, t, s) for i, t, s in rows if t)
    for query, cross in ((catalog.cross_speaker_duplicates, True), (catalog.redundancy_by_distance, False)):
        want = []
        for i, (_, _, a, si) in enumerate(blocks):
            for j in range(i + 1, min(i + 6, len(blocks))):
                b, sj = blocks[j][2], blocks[j][3]
                n = longest_common(a, b)
                if n > 40 and 2 * n > min(len(a), len(b)) and not (cross and (si == sj or "paul paul" in a + b)):
                    want.append((i, j, n) if cross else (j - i, si == sj))
        got = query(spark, d).collect()
        if cross:
            assert sorted((r["i"], r["j"], r["shared_chars"]) for r in got) == want and max(n for *_, n in want) > 600
        else:
            assert {(r["distance"], r["same_speaker"]): r["n"] for r in got} == {k: want.count(k) for k in want}


def test_voices_of_all_labels(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(v, v // 2 % 8, rng.normal(size=4).tolist()) for v in range(64)]
    d = written(spark, tmp_path, "embeddings", rows, "vec_id long, label int, embedding array<float>")
    unit = lambda m: m / np.linalg.norm(m)
    a, b = ([unit(np.mean([np.float32(x).astype(float) for v, y, x in rows if v % 2 == side and y == k], axis=0)) for k in range(8)] for side in (0, 1))
    sim = np.array(a) @ np.array(b).T
    got = {(r["speaker_a"], r["speaker_b"]): r["similarity"] for r in catalog.cosine_matrix(spark, d).collect()}
    assert len(got) == 64 and all(abs(got[f"S{i}", f"S{j}"] - sim[i, j]) < 2e-6 for i in range(8) for j in range(8))
    best = max(itertools.permutations(range(8)), key=lambda p: sum(sim[i, j] for i, j in enumerate(p)))
    assert {r["speaker_a"]: r["speaker_b"] for r in catalog.match_speakers(spark, d).collect()} == {f"S{i}": f"S{j}" for i, j in enumerate(best)}


def test_voices_of_many_meetings(spark, tmp_path):
    """Every meeting is matched by itself; a label that one side lacks is not a speaker of it."""
    size, rng = projections.MEETING_VECTORS, np.random.default_rng(6)
    rows = [(m * size + v, v // 2 % 5, rng.normal(size=3).tolist()) for m in range(6) for v in range(40)]
    rows += [(size + 100, 7, [1.0, 0.0, 0.0]), (3 * size + 101, 8, [0.0, 1.0, 0.0]), (2 * size + 102, None, [1.0, 1.0, 1.0])]
    d = written(spark, tmp_path, "embeddings", rows, "vec_id long, label int, embedding array<float>")
    unit = lambda m: m / np.linalg.norm(m)
    want = set()
    for m in range(6):
        a, b = ([unit(np.mean([np.float32(x).astype(float) for v, y, x in rows if v // size == m and v % 2 == side and y == k], axis=0)) for k in range(5)] for side in (0, 1))
        sim = np.array(a) @ np.array(b).T
        best = max(itertools.permutations(range(5)), key=lambda p: sum(sim[i, j] for i, j in enumerate(p)))  # noqa: B023
        want |= {(m, f"S{i}", f"S{j}") for i, j in enumerate(best)}
    got = catalog.match_speakers(spark, d).collect()
    assert {(r["meeting"], r["speaker_a"], r["speaker_b"]) for r in got} == want and len(got) == len(want)
    assert catalog.cosine_matrix(spark, d).count() == 6 * 25


def test_envelopes_of_all_events(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = rng.uniform(1, 500, 1000)
    d = written(spark, tmp_path, "events", [(i, float(v)) for i, v in enumerate(values)], "event_id long, value double")
    heard = np.concatenate([np.full(2000, 0.5), values * 0.3 + 0.5])
    env = {s: np.sqrt((x.reshape(-1, 10) ** 2).mean(axis=1)) for s, x in (("a", values), ("b", heard))}
    got = {(r["side"], r["win_idx"]): r["rms"] for r in catalog.rms_envelope(spark, d).collect()}
    assert len(got) == 400 and all(abs(got[s, k] - v) < 2e-6 for s, x in env.items() for k, v in enumerate(x))
    a, b = (x - x.mean() for x in env.values())
    corr = {k: sum(a[i] * b[i - k] for i in range(max(0, k), min(100, k + 300))) for k in range(-299, 100)}
    rows = catalog.cross_correlation(spark, d).collect()
    assert len(rows) == 399 and all(abs(r["corr"] - corr[r["lag"]]) < 0.011 for r in rows)
    assert [r["offset_s"] for r in catalog.offset_confidence(spark, d).collect()] == [-20.0]


def test_backchannels_of_whole_texts(spark, tmp_path):
    texts = ["Yeah, yeah", "mm-hmm", "No.", "right okay then", "two words", "yeah and so on for long", "", None]
    d = written(spark, tmp_path, "documents", [(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    assert [tuple(r) for r in catalog.backchannel_split(spark, d).collect()] == [("en", 5, 2, 3)]
