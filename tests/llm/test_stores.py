"""Byte-pair encoding, the token store, the media store."""

import os
import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnweave.llm import bpe, media, token_store

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [None, "", " ", "\n\n a\t", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "'s 'll'LL", "x" * 5000, "ab " * 4000, "\u001c\u0085  é", "你好 😀‍", "՘ᇞ0 ½³", "\U0002b73a"]


def texts():
    rng = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wild = ["".join(chr(rng.choice(points)) for _ in range(200)) for _ in range(30)]
    plain = ["".join(rng.choice("abehtnrio sS'.,\n019 ") for _ in range(300)) for _ in range(60)]
    return ODD + wild + plain + plain[:5]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], "doc_id long, text string, ids string, start int, root string")


def test_bpe_equals_the_library(spark, library):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.token_digests(docs(spark, rows)).collect()}
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, rows)).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert full[d]["ids"] == ids and full[d]["decoded"] == text, repr(t)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
    assert bpe.token_digests(docs(spark, [])).count() == 0


def test_every_class_of_characters(library):
    ours = bpe.PreTokenizer()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "a".join(map(chr, points[k : k + 4000]))
        assert [len(x) for x in ours.findall(text)] == [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_token_store(spark, library, tmp_path):
    rows = [(100 - i, t) for i, t in enumerate(texts())] + [(7000, "same"), (7000, "same")]
    folder = str(tmp_path / "store")
    token_store.write_store(docs(spark, rows), folder)
    back = {r["merkle_root"]: r for r in token_store.read_store(spark, folder).collect()}
    start = 0
    recipes = spark.read.parquet(f"{folder}/recipes").orderBy("doc_id", "start").collect()
    for (d, t), r in zip(sorted(rows, key=lambda x: x[0]), recipes, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, dtype="<u4").tobytes()
        found = back[r["merkle_root"]]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert bytes(found["ids"]) == raw and found["ids_crc32"] == zlib.crc32(raw)
        start += len(ids)
    stored = spark.read.parquet(f"{folder}/chunks")
    assert stored.count() == stored.select("digest").distinct().count()


def test_damage_to_the_token_store_is_found(spark, tmp_path):
    folder = str(tmp_path / "store")
    token_store.write_store(docs(spark, [(1, "some text"), (2, "more text")]), folder)
    chunks = spark.read.parquet(f"{folder}/chunks")
    other = chunks.agg(F.max("data").alias("d")).first()["d"]
    chunks.withColumn("data", F.lit(other)).write.parquet(str(tmp_path / "bad/chunks"))
    spark.read.parquet(f"{folder}/recipes").write.parquet(str(tmp_path / "bad/recipes"))
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, str(tmp_path / "bad")).collect()


def test_empty_token_store(spark, tmp_path):
    token_store.write_store(docs(spark, []), str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = media.cut_points(data)
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= media.MAX_CHUNK
    moved = media.cut_points(b"new start" + data)
    assert len({e + 9 for e in ends} & set(moved)) > len(ends) * 0.7
    ids = rng.integers(0, 50_000, 60_000)
    cuts, other = token_store.cut_points(ids), token_store.cut_points(np.concatenate([ids[:10], ids]))
    assert cuts[-1] == len(ids) and len({c + 10 for c in cuts} & set(other)) > len(cuts) * 0.7


def test_media(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = list(enumerate([*ODD, long, "prefix " + long, long])) + [(3, ODD[3])]
    name = f"chunks_{uuid.uuid4().hex}"
    recipes = media.write_media(docs(spark, rows), name)
    by_root = {bytes(r["root"]): r for r in media.read_media(recipes, name).collect()}
    kept = recipes.collect()
    assert len(kept) == len(rows)
    want = dict(rows)
    for r in kept:
        raw = (want[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        m = by_root[bytes(r["root"])]
        assert (r["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-32:]))
        assert bytes(m["media"])[44:] == payload and m["media_sha256"] == brute.sha(bytes(m["media"])) and m["media_bytes"] == len(payload) + 44
    chunks = spark.table(name)
    total = sum(len(x) for x in recipes.select("digests").toPandas().digests)
    assert chunks.count() == chunks.select("digest").distinct().count() < total


def test_media_is_a_wav_file(tmp_path):
    import wave

    n, payload = media.payload_of("héllo")
    path = tmp_path / "x.wav"
    path.write_bytes(media.wav_header(len(payload)) + payload)
    with wave.open(str(path)) as f:
        assert (f.getsampwidth(), f.getnchannels(), f.readframes(f.getnframes())) == (1, 1, payload) and n == 6


def test_a_missing_chunk_is_found(spark):
    a, b = (f"chunks_{uuid.uuid4().hex}" for _ in range(2))
    recipes = media.write_media(docs(spark, [(1, "text")]), a)
    media.write_media(docs(spark, [(1, "other")]), b)
    with pytest.raises(Exception, match="no chunk"):
        media.read_media(recipes, b).collect()


def test_chunks_in_another_order_are_found(spark):
    name = f"chunks_{uuid.uuid4().hex}"
    rng = random.Random(9)
    recipes = media.write_media(docs(spark, [(1, "".join(rng.choice("abcdefgh ") for _ in range(40_000)))]), name)
    assert len(recipes.first()["digests"]) > 8
    swapped = recipes.withColumn("digests", F.reverse("digests"))
    with pytest.raises(Exception, match="is not the file of"):
        media.read_media(swapped, name).collect()


def test_small_texts_are_cut_too():
    rng = random.Random(1)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(3000)) for _ in range(50)]
    assert sum(len(media.cut_points(t.encode())) for t in texts) > 90
