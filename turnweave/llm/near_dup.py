"""Operator 8: MinHash near-duplicates, verified links, and connected components.

Every text becomes a set of hashed word shingles.  Texts with equal sets are one node from the start.  HASHES
minima of universal hash functions form a signature; BANDS bands of ROWS minima put nodes into buckets, and
a pair with similarity 0.8 shares no bucket with chance (1 - 0.8**5)**40 = 1.3e-7.  Pairs pass two tests of
four bits of each minimum, over FIRST_LONGS longs and over all; a true link fails one of them with a chance of at most
2 * TAIL = 2e-6 (exact binomial tails).  They are then confirmed on the full sets of both texts.

First each member of a bucket is tested against the bucket's center, the node that meets most others over all its buckets
(of a text and its copies, the text), and components are formed.  That is one pair for each member, and it settles
copies of any number.  Then members whose component is not that of the most of their bucket are tested against the bucket's
nodes in other components, so that no link between two components is lost.  These tests are signature comparisons inside
semi joins that are salted, so that no task holds a bucket, and a member that passes leaves them as one row, however many
others it is like.  The members that passed meet on full sets inside tasks, by the centers of their buckets, and of the
links that join the same components one leaves a task.  So no table or join holds the pairs; the comparisons in a bucket
whose members are all unlike one another still grow with the square of the bucket, and so do, divided by SALT_ROWS, the
copies of its rows for the salts and blocks.

Components come from alternating large-star and small-star until nothing changes; each half step is written to the
shared folder.  What is joined on a key with many rows is written first, so that Spark can split the join's large tasks.

Defined results: texts without words (null and empty ones too) have an empty set and link with nothing; a text with
fewer words than a shingle is one shingle; equal texts are in one component, which takes the least doc_id; repeated
doc_ids count as one document of either text; rows with a null doc_id are kept, link with nothing and have a null
component_id.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, gram_hashes, hashed_words, materialize, mix, portions, signed, table

BANDS, ROWS = 40, 5
#: Minima in a signature; the first BANDS * ROWS make the bands.  A packed signature keeps NIBBLES bits of each.
HASHES, NIBBLES = 480, 4
PACKED = HASHES * NIBBLES // 64
FIRST_LONGS = 8
#: Chance that a true link fails one test of signatures.
TAIL = 1e-6
#: Members of a bucket's small components that meet the whole bucket under one salt.
SALT_ROWS = 512
#: Members that one center is tested against in one group of the confirming step.
CENTER_SHARE = 256
#: Shingles of the members that a task of the last step holds as its index.
INDEX_SHINGLES = 1 << 21
_CHUNK = 256


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with A-Z lower-cased."""
    words = hashed_words((text or "").encode().lower())
    if not len(words):
        return words
    if len(words) < size:
        return np.unique(gram_hashes(words, len(words), seed=len(words)))
    return np.unique(gram_hashes(words, size))


_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(10_001, 10_001 + HASHES, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-shift hash functions (a x + b mod 2**64, upper half)."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((HASHES, min(_CHUNK, max(1, len(shingles)))), dtype=np.uint64)
    for k in range(0, len(shingles), _CHUNK):
        part = shingles[k : k + _CHUNK]
        hashed = room[:, : len(part)]
        np.multiply(_A[:, None], part[None, :], out=hashed)
        hashed += _B[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(7919))
    for j in range(ROWS):
        key = mix(key ^ rows[:, j]) + np.uint64(j)
    return signed(key)


def packed_bits(sig: np.ndarray) -> np.ndarray:
    """NIBBLES bits of every minimum, packed into longs."""
    low = mix(sig.astype(np.uint64) + np.uint64(1)) & np.uint64((1 << NIBBLES) - 1)
    shift = (np.arange(HASHES, dtype=np.uint64) % np.uint64(64 // NIBBLES)) * np.uint64(NIBBLES)
    return np.bitwise_or.reduce((low << shift).reshape(PACKED, -1), axis=1).view(np.int64)


def most_different(similarity: float, places: int = HASHES) -> int:
    """Differing places of two packed signatures that a pair of this similarity exceeds with a chance of TAIL at most."""
    p = (1 - similarity) * (1 - 2.0**-NIBBLES)
    left = 1.0
    for k in range(places):
        left -= math.comb(places, k) * p**k * (1 - p) ** (places - k)
        if left <= TAIL:
            return k
    return places


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        known: dict[bytes, np.ndarray] = {}
        for b in portions(batches):
            if len(known) > 20_000:
                known.clear()
            counts, keys, rows = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, size)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if key and key not in known:
                    sig = signature(s)
                    known[key] = np.concatenate((band_keys(sig), packed_bits(sig)))
                counts.append(len(s))
                keys.append(key)
                if key:
                    rows.append(known[key])
            found = np.array(rows, dtype=np.int64).reshape(len(rows), BANDS + PACKED)
            stops = np.concatenate(([0], np.cumsum([k is not None for k in keys])))
            missing = pa.array([k is None for k in keys], pa.bool_())
            lists = [pa.ListArray.from_arrays(pa.array(stops * part.shape[1], pa.int32()), pa.array(part.ravel()), mask=missing) for part in (found[:, :BANDS], found[:, BANDS:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), *lists], schema=SKETCH)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def alike(a: str, b: str, similarity: float):
    """Whether the packed signatures of two columns can be those of a pair of this similarity.

    A few longs are compared first, in generated code; only pairs that pass are compared in all.
    """
    step = 64 // NIBBLES
    ones = F.lit(int("1" * step, 16))

    def differing(x, y):
        z = x.bitwiseXOR(y)
        for k in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(ones))

    first = sum((differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(FIRST_LONGS)), F.lit(0))
    every = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, v: s + v)
    return (first <= most_different(similarity, FIRST_LONGS * step)) & (every <= most_different(similarity))


VERDICT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The text of b goes to groups of its center a; a center with many members has several groups, each with a copy of
    its text.  A task walks its groups in order and holds one center's set.
    """
    load = materialize(pairs.groupBy("a").agg((F.floor(F.count("*") / CENTER_SHARE) + 1).cast("int").alias("groups")))
    members = pairs.join(load, "a").select("a", F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.lit(1).alias("role"))
    centers = load.select("a", F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("role"))
    wanted = members.unionByName(centers)
    rows = wanted.join(docs.hint("merge"), "doc_id").select("a", "g", "role", "doc_id", "text").repartition("a", "g").sortWithinPartitions("a", "g", "role")

    def run(batches):
        at, center = None, None
        for b in portions(batches):
            out = []
            for a, g, role, d, t in zip(*(b.column(c).to_pylist() for c in ("a", "g", "role", "doc_id", "text")), strict=True):
                s = shingle_set(t, size)
                if role == 0:
                    at, center = (a, g), s
                elif at == (a, g):
                    both = len(np.intersect1d(center, s, assume_unique=True))
                    if 100 * both >= percent * (len(center) + len(s) - both):
                        out.append((a, d))
            cols = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=VERDICT)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) of every node of edges (a, b)."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: the node and its smaller neighbours are tied to the least of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        stamp = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now, least, large, low)
        now = after
        if stamp == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = stamp


def forest(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, of rows (center, g, role, doc_id, component, text) with a group (center, g) in one task.

    The sets of a group's seekers (role 0) are held as an index, the others pass by one at a time, and each is compared with
    all seekers at once, by exact intersections.  Of the links that join the same components only one is returned.
    """

    def run(batches):
        at, seekers, index = None, [], None
        for b in portions(batches):
            out = []
            for center, g, role, d, c, t in zip(*(b.column(x).to_pylist() for x in ("center", "g", "role", "doc_id", "component", "text")), strict=True):
                s = shingle_set(t, size)
                if at != (center, g):
                    at, seekers, index, above = (center, g), [], None, {}
                if not len(s):
                    continue
                if role == 0:
                    seekers.append((d, c, s))
                    continue
                if index is None:
                    names = [x[0] for x in seekers]
                    roots = np.array([x[1] for x in seekers], dtype=np.int64)
                    sizes = np.array([len(x[2]) for x in seekers], dtype=np.int64)
                    index, places = np.unique(np.concatenate([x[2] for x in seekers] or [s[:0]]), return_inverse=True)
                    places, starts, seekers = places.astype(np.int32), np.cumsum(sizes) - sizes, []
                    mark = np.zeros(len(index), dtype=np.uint8)
                while c in above:
                    c = above[c]
                open_ = (roots != c) & (100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s)))
                if not open_.any():
                    continue
                found = np.searchsorted(index, s)
                found = found[index[np.minimum(found, len(index) - 1)] == s]
                mark[found] = 1
                both = np.add.reduceat(mark[places], starts, dtype=np.int64)
                mark[found] = 0
                for k in np.flatnonzero(open_ & (100 * both >= percent * (sizes + len(s) - both))):
                    if (r := int(roots[k])) != c:
                        out.append((names[k], d))
                        above[r] = c
                        roots[roots == r] = c
            cols = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=VERDICT)

    return groups.mapInArrow(run, "a long, b long").distinct()


def crossing_pairs(placed: DataFrame, bits: DataFrame, docs: DataFrame, similarity: float, size: int, percent: int) -> DataFrame:
    """Links (a, b) that tie all components of placed (at, band, center, rep, component) with a link in a shared bucket.

    Within a bucket the members outside its largest component (few) are dealt to salts, SALT_ROWS for each, and the bucket's rows
    are copied to each salt that it has.  Semi joins keep the members with an alike signature in another component, so a
    member is one row however many such others it has; pairs are formed and confirmed within the tasks of forest().
    """
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    largest = F.max_by("component", F.struct("size", -F.col("component")))
    main = parts.groupBy("band").agg(largest.alias("main"), F.count("*").alias("n_parts"), (F.sum("size") - F.max("size")).alias("n_few")).where("n_parts > 1")
    main = materialize(main.select("band", "main", (F.col("n_few") / SALT_ROWS + 1).cast("int").alias("salts")))
    rows = materialize(placed.join(main, "band").join(bits, "rep").select("at", "band", "center", "main", "salts", "component", "rep", "n_shingles", "bits", "bands"))
    few = rows.where("component <> main").select("at", F.col("band").alias("a_band"), F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("a_salt"), "center", F.col("rep").alias("a"), F.col("component").alias("ca"), "n_shingles", F.col("bits").alias("a_bits"), F.col("bands").alias("a_bands"))
    every = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "center", F.col("rep").alias("b"), F.col("component").alias("cb"), "bits", "bands", (F.col("component") == F.col("main")).alias("is_main"))
    # a pair that shares several bands is taken in the first of them
    first_meeting = F.array_position(F.zip_with("a_bands", "bands", lambda x, y: x == y), True) == F.col("at") + 1
    meet = F.expr("band = a_band and salt = a_salt and ca <> cb and (is_main or a < b)") & alike("a_bits", "bits", similarity) & first_meeting
    met = materialize(every.join(few.drop("center", "n_shingles"), meet, "left_semi"))
    if not met.limit(1).count():
        forget(main, rows)
        return met.select(F.col("b").alias("a"), "b")
    seekers = materialize(few.join(met.drop("center"), meet, "left_semi").select("center", F.col("a").alias("doc_id"), F.col("ca").alias("component"), "n_shingles").distinct())
    others = materialize(met.select("center", F.col("b").alias("doc_id"), F.col("cb").alias("component")).distinct())
    # blocks of seekers meet blocks of others: each pair of a center in one group
    blocks = seekers.groupBy("center").agg((F.count("*") / SALT_ROWS + F.sum("n_shingles") / INDEX_SHINGLES + 1).cast("int").alias("blocks"))
    shares = others.groupBy("center").agg((F.count("*") / SALT_ROWS + 1).cast("int").alias("shares"))
    load = materialize(blocks.join(shares, "center"))
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seeking = seekers.join(load, "center").select("center", dealt("blocks").alias("block"), "shares", upto("shares").alias("share"), F.lit(0).alias("role"), "doc_id", "component").distinct()
    passing = others.join(load, "center").select("center", upto("blocks").alias("block"), "shares", dealt("shares").alias("share"), F.lit(1).alias("role"), "doc_id", "component")
    wanted = materialize(seeking.unionByName(passing).select("center", (F.col("block") * F.col("shares") + F.col("share")).alias("g"), "role", "doc_id", "component"))
    groups = wanted.join(docs.hint("merge"), "doc_id").repartition("center", "g").sortWithinPartitions("center", "g", "role")
    links = materialize(forest(groups, size, percent))
    forget(main, rows, met, seekers, others, load, wanted)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = materialize(sketches(docs, size))
    similarity = percent / 100

    sets = materialize(sketch.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    nodes = sketch.join(sets.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").where("set_key is not null").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "bits")
    rows = nodes.select("rep", F.posexplode("bands").alias("at", "band"))
    shared = materialize(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = materialize(rows.join(shared.hint("merge"), "band"))
    # the text that the others are copies of meets most of them: it is the center of its buckets
    weight = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    centers = materialize(met.join(weight, "rep").groupBy("band").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("center")))
    buckets = materialize(met.join(centers.hint("merge"), "band").select("at", "band", "center", "rep"))
    forget(met, shared, centers)

    bits = materialize(nodes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "n_shingles", "bits", "bands"))
    pairs = buckets.where("rep <> center").select("center", "rep").distinct().join(bits.drop("bands"), "rep")
    star = pairs.join(bits.select(F.col("rep").alias("center"), F.col("bits").alias("center_bits")), "center").where(alike("bits", "center_bits", similarity)).select(F.col("center").alias("a"), F.col("rep").alias("b"))
    edges = materialize(confirm(materialize(star), docs, size, percent))
    comp = components(edges)

    placed = buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = crossing_pairs(placed, bits, docs, similarity, size, percent)
    if more.limit(1).count():
        comp = components(edges.unionByName(more))
    forget(buckets, bits)

    # sets of one row that link with nothing are their own component
    linked = sets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").where("n > 1 or component is not null").select("set_key", F.coalesce("component", "rep").alias("_component"))
    narrow = sketch.select("doc_id", "n_shingles", "set_key")
    found = narrow.where("set_key is not null").join(materialize(linked), "set_key", "left").select("doc_id", "n_shingles", "_component")
    out = found.unionByName(narrow.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("_component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


#: Links by counting shared shingles of all pairs, then all that can be reached; for small tables only.
OP8_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM texts WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS low FROM texts UNION SELECT w.b, r.low FROM reached r JOIN ways w ON w.a = r.doc_id),
least AS (SELECT doc_id, min(low) AS component_id FROM reached GROUP BY doc_id)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, t.doc_id = l.component_id AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
"""
