"""Quality, toxicity, and the whole pipeline against its stages one by one."""

import os
import random
import zlib

import pytest

import corpus_pipeline
from tests.llm import brute
from turnweave.llm import bpe, decontaminate, quality, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def labelled(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zarkun" + rng.choice(vocabulary), "1dіot", "m0rоn", "TR@SH"]))
        if bad:
            w = [x + rng.choice(["%%%", "$$$", "###"]) for x in w]
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return rows


def accuracy(model, rows, k, at):
    return sum((model.score(r[1]) >= at) == (r[k] == 1) for r in rows) / len(rows)


def frames(spark, rows):
    """documents and labels of rows (doc_id, text, quality, toxic), with clashing columns."""
    docs = spark.createDataFrame([(d, t, 1, "y", "h") for d, t, *_ in rows], "doc_id long, text string, y int, score string, h string")
    labels = spark.createDataFrame([(d, q, x, "t") for d, _, q, x in rows], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_quality_held_out(spark):
    rows = labelled(1)
    model = quality.train_quality(*frames(spark, rows[:300]))
    assert accuracy(model, rows[300:], 2, 0.5) > 0.95


def test_toxicity_held_out(spark):
    rows = labelled(2, 600)
    model = toxicity.train_toxicity(*frames(spark, rows[:450]))
    assert "zark" in {s[:4] for s in model.weights}
    assert accuracy(model, rows[450:], 3, 0.7) > 0.97


def test_labels_decide_over_the_built_in_lexicon(spark):
    rows = labelled(7, 300)
    rows = [(d, t.replace("TR@SH", "") + (" trash" if not x else ""), q, x) for d, t, q, x in rows]
    model = toxicity.train_toxicity(*frames(spark, rows))
    assert "trash" not in model.words and "vermin" in model.words
    assert model.score("trash") == model.score("harmless")


def test_sample_is_bounded_and_the_same_at_any_partitioning(spark):
    rows = labelled(8, 200)
    docs, labels = frames(spark, [*rows, (5, "another text of five", None, None), (None, "no id", 1, 1)])
    labels = labels.unionByName(labels.where("doc_id = 7").withColumn("toxic", 1 - labels["toxic"]))
    for n in (50, 1000):
        got = [sorted(tuple(r) for r in quality.labelled_sample(d, x, "toxic", n).collect()) for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(5)))]
        assert got[0] == got[1] and len(got[0]) == min(n, 199) and 7 not in {r[0] for r in got[0]}
    long = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(50_000)), 1)], "doc_id long, text string, y int")
    assert len(quality.excerpts(long, 8192)[0][1]) == 8192


def test_hits_in_long_texts_take_time_in_proportion():
    model = toxicity.ToxicityModel({"trash": 4.0})
    assert model.hits("the trash can and trash " * 20_000)[0] == 4.0 * 20_000


def test_folding_and_exceptions():
    model = toxicity.ToxicityModel({}, words={toxicity.folded(w).strip(): 4.0 for w in toxicity.BUILT_IN})
    assert model.hits("You іd1ot, m0ron!")[0] == 8.0
    assert model.hits("take the tr@sh out")[0] == 4.0
    assert model.hits("beside the trash can")[0] == 0.0
    assert model.hits("Pathétic")[0] == 4.0
    assert model.hits("retardant Moronic Dumbledore Jerkins Creeping jerkin")[0] == 0.0 and model.hits("idiots! Crappy losers, b1tches")[0] == 16.0


def test_without_labels_one_sure_insult_is_enough(spark):
    docs = spark.createDataFrame([(1, "you are an 1d10t", 0, 0)], "doc_id long, text string, q int, h int")
    model = toxicity.train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score("you are an 1d10t") >= toxicity.THRESHOLD > 0.5 > max(model.score(t) for t in ("that is ugly", "the trash can", "", None, "retardant foam", "a long text of words " * 400 + "idiot"))
    assert model.hits(None or "") == (0.0, 0)


@pytest.mark.parametrize("train", [quality.train_quality, toxicity.train_toxicity])
def test_models_without_labels(spark, train):
    for rows in ([], [(1, "a b c", 1, 1)], [(1, "", 0, 0), (2, "", 1, 1)], [(1, "x y", None, None)]):
        model = train(*frames(spark, rows))
        assert all(0 <= model.score(t) <= 1 for t in (None, "", "some words", "x" * 100_000))
        assert quality.score_documents(frames(spark, [])[0], model).count() == 0


def write(spark, folder, rows):
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, q, x) for d, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, (rows[3][1] or "")[:150]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_queries_score_every_row(spark, tmp_path):
    rows = labelled(3, 200) + [(900, None, None, None), (901, "", 1, 0), (902, "x " * 30_000, None, None)]
    write(spark, str(tmp_path), rows)
    for query, modulus, held, at in ((quality.op9_quality, 5, 0, 0.3), (toxicity.op10_toxicity, 3, 1, 0.7)):
        got = {r["doc_id"]: r for r in query(spark, str(tmp_path)).collect()}
        assert set(got) == {r[0] for r in rows}
        for d, r in got.items():
            assert r["held_out"] == (zlib.crc32(str(d).encode()) % modulus == held)
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at)


def test_held_out_labels_do_not_change_scores(spark, tmp_path):
    rows = labelled(4, 200)
    flipped = [(d, t, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 1 - x if zlib.crc32(str(d).encode()) % 3 == 1 else x) for d, t, q, x in rows]
    for name, r in (("a", rows), ("b", flipped)):
        write(spark, str(tmp_path / name), r)
    for query in (quality.op9_quality, toxicity.op10_toxicity):
        a, b = ({r["doc_id"]: r["score"] for r in query(spark, str(tmp_path / n)).collect()} for n in "ab")
        assert a == b


def test_pipeline_against_its_stages(spark, tmp_path):
    """Each stage's promise, restated on lists of what the stage before it kept."""
    rng = random.Random(5)
    rows = labelled(6, 120)
    passage = " ".join(f"shared{i}" for i in range(60))
    extra = []
    for i, (_, t, q, x) in enumerate(rows[:30]):
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        extra.append((1000 + i, " ".join(w) if i % 2 else t, q, x))
        extra.append((2000 + i, " ".join(rng.sample(w, len(w))) + " " + passage + " end", None, None))
    rows = [*rows, *extra, (3000, None, None, None), (3001, "", None, None)]
    write(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept.append(len(before))
        if name == "toxicity":
            toxic = {d for d, _, _, x in rows if x}
            assert len(toxic - set(after)) > 0.9 * len(toxic) and all(after[d] == before[d] for d in after)
            assert len({d for d, _, _, x in rows if x == 0} - set(after)) <= 2
        elif name == "near_dedup":
            comp = brute.components(list(before.items()), 5, 80)
            assert after == {d: t for d, t in before.items() if comp[d] == d}
        elif name == "substring":
            want = {d: (before[d] if not n else b" ".join(k).decode()) for d, k, n in brute.without_repeats(list(before.items()), 50)}
            assert after == want
        elif name == "decontaminate":
            item = decontaminate.normalized(rows[3][1][:150])
            leaked = {d for d, t in before.items() if brute.sub_distance(item, decontaminate.normalized(t)) <= int(0.08 * (len(item) - 2))}
            assert after == {d: t for d, t in before.items() if d not in leaked}
        else:
            encoder = bpe.encoder(bpe.default_vocabulary())
            got = {r["doc_id"]: r for r in docs.collect()}
            assert {d: r["ids"] for d, r in got.items()} == {d: encoder.encode(t or "") for d, t in before.items()}
            assert all(r["decoded_sha256"] == brute.sha(before[d] or "") for d, r in got.items())
    assert kept[0] > kept[1] > kept[2] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@needs_data
def test_quality_on_the_tables(spark):
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == labels[d] for d in held) / len(held) > 0.9


def test_pipeline_with_repeated_and_missing_ids(spark, tmp_path):
    """Every stage keeps each row that it has no reason to drop, once, whatever its doc_id."""
    rng = random.Random(12)
    text = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(90))
    passage = " ".join(f"shared{i}" for i in range(60))
    item = "an item of the benchmark that is long enough to be looked for"
    a, b, c = text(), text(), text()
    rows = [(1, a + " " + passage), (7, b + " " + passage), (7, c + " " + passage), (7, b + " " + passage), (None, text()), (None, text() + " " + item), (8, text() + " " + item), (9, None)]
    write(spark, str(tmp_path), [(d, t, None, None) for d, t in rows] + labelled(1, 6)[:0])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
    assert [len(left[n]) for n in left] == [8, 8, 8, 6, 6]
    cut = [(r["doc_id"], r["text"]) for r in left["substring"]]
    assert sorted(t for d, t in cut if d == 7) == sorted([b, c, b]) and dict(cut)[1] == a + " " + passage


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), labelled(6, 30))
    spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none")
    docs = spark.read.parquet(f"{tmp_path}/none")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
