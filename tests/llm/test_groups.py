"""Whitened embeddings, SimHash classes and spelling variants, against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from turnweave.llm import simhash, spelling, whitening
from turnweave.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, v int, n int, component string"
DOC = "doc_id long, text string, lang string, fp int, comp string, key string, word string, n int"


def docs(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(d, t, "en", 7, "x", "y", "z", 1) for d, t in rows], DOC)


# -- operator 11


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], VECTORS)


def sample_vectors(width, count=150, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(count, width)) @ rng.normal(size=(width, width)) + rng.normal(size=width)
    rows = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(mixed)]
    odd = [(900, None), (901, []), (902, [None, *rows[0][1][1:]]), (903, [float("nan"), *rows[0][1][1:]]), (904, [float("-inf"), *rows[0][1][1:]])]
    return [*rows, rows[5], rows[5], (None, rows[7][1]), *odd], [*rows, rows[5], rows[5], (None, rows[7][1])]


def integers(rows):
    return np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000


@pytest.mark.parametrize(("width", "tile", "block"), [(5, 32, 1 << 20), (40, 8, 64), (64, 32, 40 * 64 * 8)])
def test_whitening_against_numpy(spark, monkeypatch, width, tile, block):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    given, kept = sample_vectors(width)
    got = whitening.whiten(vectors(spark, given)).collect()
    x = integers(kept)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    k = len(e)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and all(abs(r["identity_error"]) < 1e-8 for r in got)
    white = centred @ u / np.sqrt(e)
    deviation = {}
    for (i, _), row in zip(kept, x, strict=True):
        deviation[i] = sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))
    by = {}
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]]
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(k):
        assert np.isclose(by[0, c + 1][0]["explained"], e[c] / np.trace(cov), rtol=1e-9)
        mine = np.array([by[i, c + 1][0]["whitened"] for i, _ in kept])
        assert np.allclose(mine * np.sign(mine @ white[:, c]), white[:, c], atol=1e-7)
    assert len(by[5, 1]) == 3 and len(by[None, 1]) == 1


def test_whitening_of_little(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])] * 3):
        out = whitening.whiten(vectors(spark, rows))
        assert out.columns == columns and out.count() == 0
    # one dimension has no variance: one component
    line = whitening.whiten(vectors(spark, [(k, [float(k), 4.0]) for k in range(5)])).collect()
    assert len(line) == 5 and {r["component"] for r in line} == {1} and all(np.isclose(r["explained"], 1) for r in line)
    with pytest.raises(ValueError, match="unlike length"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_exact_deviations_beyond_a_long():
    centre = whitening.Centre(10**11, [3 * 10**11 + 1, 5])
    steps = np.array([[4, -7], [-900, 2]], dtype=np.int64)
    want = [sum((10**11 * int(y) - int(r)) ** 2 for y, r in zip(row, centre.rest, strict=True)) for row in steps]
    assert [int(d) for d in centre.deviations(steps).to_pylist()] == want and want[1] > 1 << 63


def test_op11(spark, tmp_path):
    given, kept = sample_vectors(6, 40)
    vectors(spark, given).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op11_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.count() == len(kept) * 6


# -- operator 12


def plain_print(text, size=4):
    w = brute.words(brute.ascii_lower(text))
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    """prints: [(name, fingerprint)]; the least name that links lead to, by comparing all pairs."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[top(i)] = min(d, least.get(top(i), d))
    return [least[top(i)] for i in range(len(prints))]


def near_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "naïve", "x" * 700, "longer" * 300]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 300))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        out.append((3000 - 7 * i, rng.choice((" ", "\n", " \t\x0b")).join(w)))
    return [*out, (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (7, out[0][1]), (8, "lone word " * 4000), (9, "\x00 \x00\x01 b c")]


def test_spans_hashed_together():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(6000))
    spans = [(rng.randrange(3000), n) for n in [*range(130), 1023, 1024, 1025, 3000]]
    start, length = np.array(spans).T
    assert simhash.xxh64_spans(data, start, length).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed=42) for a, n in spans]


@pytest.mark.parametrize("size", [4, 2])
def test_fingerprints(size):
    texts = [t for _, t in near_texts(5, 60)]
    assert simhash.fingerprints(texts, size).tolist() == [plain_print(t, size) for t in texts]
    assert simhash.fingerprints([]).tolist() == [] and simhash.fingerprints([None, " "]).tolist() == [0, 0]


def test_op12(spark, tmp_path):
    rows = near_texts(11, 150)
    docs(spark, [*rows, (None, rows[0][1])]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_simhash"](spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()]
    prints = [(d, plain_print(t)) for d, t in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, classes(prints, 4), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, [*want, (None, f"{prints[0][1]:016x}", None)]))
    assert 5 < len({c for _, _, c in want}) < 120
    assert simhash.simhash_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("distance", "heavy", "salt"), [(4, 64, 1024), (4, 3, 5), (3, 2, 4), (5, 3, 8), (1, 2, 3), (0, 2, 3), (6, 1000, 9)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, distance, heavy, salt):
    """Clouds round a few centers, one of them dense, and chains that only single links hold together."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "SALT_ROWS", salt)
    rng = random.Random(distance)
    prints = {0, (1 << 64) - 1}
    for spread, n in ((3, 80), (7, 40), (12, 40)):
        center = rng.getrandbits(64)
        for _ in range(n):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))))
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(distance, distance + 1)))
        prints.add(x)
    prints = sorted(p - (p >> 63 << 64) for p in prints)
    named = [(p, p & (1 << 64) - 1) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p, p) for p in prints], "fp long, comp long"), distance).collect()
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(p) for p in prints] == classes(named, distance)


# -- operator 13


def variants(rows):
    counts = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    letters = sorted({c for w in counts for c in w})
    out = {}
    for w, n in counts.items():
        changed = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = [x for x in changed if x in counts and x != w]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w, x in out.items():
        while out[w][2]:
            w = out[w][2]
        x.append(w)
    return {(w, *x) for w, x in out.items()}


def wordy(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 13))) for _ in range(25)] + ["Zebraçao", "aaaaaaaa", "abababab"]
    rows = []
    for d in range(60):
        w = []
        for _ in range(40):
            s = rng.choice(stems[: 3 + d // 2])
            if rng.random() < 0.25:
                k = rng.randrange(len(s))
                s = rng.choice((s[:k] + s[k + 1 :], s[:k] + rng.choice("abÿ") + s[k + 1 :], s[:k] + rng.choice("ab") + s[k:]))
            w.append(rng.choice((s, s.upper(), s.capitalize())))
        rows.append((d, rng.choice((" ", "-", "Ÿ", "1")).join(w)))
    return [*rows, (None, rows[0][1]), (5, rows[5][1]), (99, None), (98, ""), (97, "q" * 5_000), (97, "q" * 5_000), (96, "q" * 4_999), (95, "q" * 4_999)]


@pytest.mark.parametrize(("seed", "shard"), [(1, 128), (2, 4), (3, 2)])
def test_variants_against_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    rows = wordy(seed)
    got = spelling.spelling_variants(docs(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = variants([r for r in rows if r[0] not in (95, 96, 97)])
    short = {tuple(r) for r in got if len(r["word"]) < 1000}
    assert len(got) == len({r["word"] for r in got}) and short == want and any(w[3] for w in want) and any(w[1] and not w[3] for w in want)
    assert {len(r["word"]) - 4_998 for r in got if len(r["word"]) > 1000} <= {0, 1, 2}


def test_chains_of_forms(spark):
    chain = [f"w{k}" for k in range(12)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [("x", "w3")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "w11") for w in [*chain[:-1], "x"]}


def test_op13_of_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_spelling"](spark, str(tmp_path))
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"] and out.count() == 0
    assert out.where(F.col("n") < 2).count() == 0
