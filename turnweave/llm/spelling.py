"""Operator 13: groups of spelling variants by a positional q-gram inverted index.

Words are counted over all texts by built-in functions.  Two words are near if one inserted, deleted or replaced code point
turns one into the other.  One edit leaves either the first or the last half of the longer word as it is, so the index is dealt to
shards by (length m of the longer word, kept half): a word goes to the shards of m = its length and m = its length + 1.  A shard of
more than SHARD words is dealt again by halves of what is not kept yet, and so on, until at most one code point is left; at that
depth the words of a shard differ at one place only.  No near pair is lost, and no shard is large.

Within a shard each word's postings (gram, position) -> words are merged by a heap, for its own positions and those beside them
(the position limit) and for words of the shard's two lengths (the length limit); a word that is met under fewer than
m - q + 1 - q grams is out (one edit touches at most q grams), and the rest is verified.

Each word then takes its near word of the largest count as its form, if that count is at least RATIO times its own, and chains of forms
are followed by pointer doubling.

Defined results: null and empty texts have no words; a null doc_id counts as the text "null"; repeated rows count again;
ties of counts go to the smaller word in code-point order; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hand_back, materialize, table

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: Words of a shard; larger ones are dealt again.
SHARD = 128
Q = 2

NEAR = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words of LEAST_LENGTH or more; shorter runs cannot give one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi) under both halves of what is between lo and hi, with the key of their shard."""
    half: Column = F.expr("(m - lo - hi) div 2").cast("int")
    both = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi")), F.struct(F.col("lo"), (F.col("hi") + half).alias("hi")))
    at = rows.select("word", "n", "m", F.explode(both).alias("x")).select("word", "n", "m", "x.lo", "x.hi")
    kept = F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, hi)"))
    return at.select(kept.alias("key"), "m", "lo", "hi", "word", "n")


def shards(words: DataFrame) -> DataFrame:
    """key, m, lo, hi, word, n: every word under all shards that it belongs to."""
    lengths = F.array(F.char_length("word"), F.char_length("word") + 1)
    rows = materialize(_halves(words.select("word", "n", F.explode(lengths).alias("m"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))))
    done = []
    while True:
        large = materialize(rows.where("m - lo - hi > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SHARD).select("key"))
        if not large.limit(1).count():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = materialize(_halves(rows.join(large, "key", "left_semi").drop("key")).distinct())
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k, least = 0, min(len(a), len(b))
    while k < least and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def near_in_shard(m: int, lo: int, hi: int, words: list[str]) -> list[tuple[int, int]]:
    """Pairs of places in words, one of them of length m at least, that are one edit apart."""
    before, after = min(lo, 1), min(hi, 1)
    middle = [w[lo - before : len(w) - hi + after] for w in words]
    least = m - lo - hi + before + after - Q + 1 - Q
    found = []
    if least < 1:
        for x, a in enumerate(words):
            found += [(x, y) for y in range(x) if (len(a) == m or len(words[y]) == m) and one_edit(a, words[y])]
        return found
    index: dict[tuple[str, int], list[int]] = {}
    for x, part in enumerate(middle):
        for p in range(len(part) - Q + 1):
            index.setdefault((part[p : p + Q], p), []).append(x)
    for x, part in enumerate(middle):
        if len(words[x]) != m:
            continue
        lists = [index[k] for p in range(len(part) - Q + 1) for k in ((part[p : p + Q], p - 1), (part[p : p + Q], p), (part[p : p + Q], p + 1)) if k in index]
        at, met = -1, 0
        for y in merge(*lists):
            if y != at:
                at, met = y, 0
            met += 1
            # a pair of two words of length m is taken from the later one
            if met == least and (y < x or len(words[y]) != m) and one_edit(words[x], words[y]):
                found.append((x, y))
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb with a < b for all near words of words (word, n)."""
    rows = shards(words).repartition("key").sortWithinPartitions("key", "m", "lo", "hi")

    def run(batches):
        held: list[tuple] = []

        def settle(group):
            (_, m, lo, hi), names = group[0][:4], [r[4] for r in group]
            for x, y in near_in_shard(m, lo, hi, names):
                a, b = sorted((group[x][4:], group[y][4:]))
                yield (*a, *b)

        for b in batches:
            key = b.column("key").to_numpy()
            same = key[1:] == key[:-1]
            # a shard of one word has no pairs; the batch's ends may go on in the next
            alone = ~(np.concatenate(([True], same)) | np.concatenate((same, [True])))
            out = []
            for r in zip(*(c.to_pylist() for c in b.filter(pa.array(~alone)).columns), strict=True):
                if held and held[0][:4] != r[:4]:
                    if len(held) > 1:
                        out += settle(held)
                    held = []
                held.append(r)
            cols = zip(*dict.fromkeys(out), strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, NEAR, strict=True)], schema=NEAR)
        last = list(settle(held)) if len(held) > 1 else []
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last, strict=True), NEAR, strict=True)], schema=NEAR)
        hand_back()

    return rows.mapInArrow(run, "a string, na long, b string, nb long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and the root that its forms lead to, of forms (word, form): each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        going = after.where("moved").limit(1).count()
        forget(now)
        now = after.drop("moved")
        if not going:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of docs (doc_id, text) that occur LEAST_COUNT times or more."""
    words = materialize(word_counts(docs).where(F.col("n") >= LEAST_COUNT))
    pairs = materialize(near_pairs(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.first("n").alias("own"))
    likely = -F.col("best.less") >= RATIO * F.col("own")
    stats = materialize(best.select("word", "n_near", F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n")))
    ends = roots(stats.where("form is not null").select("word", "form"))
    out = words.join(stats, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
