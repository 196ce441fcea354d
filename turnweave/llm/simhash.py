"""Operator 12: SimHash fingerprints, multi-index hashing, and connected components.

A text's fingerprint has a bit set where over half of its word shingles, repeats included, have it set in their XXH64
(UTF-8, seed 42).  Equal fingerprints are one node from the start, so copies of any number cost one row.

Links at DISTANCE or fewer differing bits are found by multi-index hashing.  The 64 bits are cut into SEGMENTS segments.  With
distance = SEGMENTS * r + a, a pair within the distance differs by at most r bits in one of the first a + 1 segments
or by at most r - 1 in one of the others; if not, it would differ by (a + 1)(r + 1) + (SEGMENTS - a - 1) r = distance + 1.  So
each fingerprint is entered under its own segments and looks up the small Hamming ball round each of them; every meeting
is verified on all 64 bits.  The search is exact.

Pairs are formed within tasks, by segment value, and a task returns only such links as join components that it has not
joined yet.  Where many fingerprints crowd round one segment value (HEAVY), those within two bits of each other are first
tied by their common neighbours at one flipped bit (65 rows each, no pairs) and named by the least; then only members outside the largest of the groups
so tied at a segment value are held, dealt to salts of SALT_ROWS, and the value's rows pass by each salt.  Rows are thus
bounded by 65 for a fingerprint and the copies for salts; comparisons between crowded fingerprints that are not within two bits
of each other still grow with the square of their number, spread over tasks.

Defined results: null texts and texts without words have fingerprint zero and are linked like any other; a text with fewer
words than a shingle is one shingle; every row is returned once, repeated doc_ids too, each linked by its own fingerprint;
rows with a null doc_id are kept, link with nothing and have a null component_id.  An empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, portions, table
from .near_dup import components

SIZE, DISTANCE, SEGMENTS, SEED = 4, 4, 3, 42
#: Fingerprints with one segment value from which on those within two bits are tied first.
HEAVY = 64
#: Members of a segment value that one task holds.
SALT_ROWS = 1024
#: Shingles hashed and pairs compared at a time; spans longer than LONG bytes are hashed by the library.
_CHUNK, LONG = 1 << 19, 1024

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64_spans(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start : start + length] for every span, all spans at once; each step works on the spans that still have it."""
    room = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray((len(room) - 7,), dtype="<u8", buffer=room, strides=(1,))
    four = np.ndarray((len(room) - 3,), dtype="<u4", buffer=room, strides=(1,))
    seed64 = np.uint64(seed)
    out = np.full(len(start), seed64 + P5, dtype=np.uint64)
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        wide = np.flatnonzero((left >= 32) & (left <= LONG))
        if len(wide):
            lanes = [np.full(len(wide), v, dtype=np.uint64) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            go, stripes = np.arange(len(wide)), left[wide] // 32
            while len(go):
                place = at[wide[go]]
                for k, lane in enumerate(lanes):
                    lane[go] = _turn(lane[go] + eight[place + 8 * k] * P2, 31) * P1
                at[wide[go]] += 32
                stripes[go] -= 1
                go = go[stripes[go] > 0]
            h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                h = (h ^ (_turn(lane * P2, 31) * P1)) * P1 + P4
            out[wide] = h
            left[wide] %= 32
        out += length.astype(np.uint64)
        go = np.flatnonzero((left >= 8) & (left <= LONG))
        while len(go):
            out[go] = _turn(out[go] ^ (_turn(eight[at[go]] * P2, 31) * P1), 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
            go = go[left[go] >= 8]
        go = np.flatnonzero((left >= 4) & (left <= LONG))
        if len(go):
            out[go] = _turn(out[go] ^ (four[at[go]].astype(np.uint64) * P1), 23) * P2 + P3
            at[go] += 4
            left[go] -= 4
        go = np.flatnonzero((left > 0) & (left <= LONG))
        while len(go):
            out[go] = _turn(out[go] ^ (room[at[go]].astype(np.uint64) * P5), 11) * P1
            at[go] += 1
            left[go] -= 1
            go = go[left[go] > 0]
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        out ^= out >> np.uint64(32)
    for k in np.flatnonzero(length > LONG):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]], seed)
    return out


def _bit_sums(hashes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each run of hashes that ends at a stop, how many have each of the 64 bits set: bytes of longs are summed, 255 at a time."""
    starts = np.concatenate(([0], stops[:-1]))
    pieces = (stops - starts + 254) // 255
    first = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = np.cumsum(pieces) - pieces
    sums = np.empty((len(stops), 8, 8), dtype=np.int64)
    for k in range(8):
        part = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), first)
        sums[:, :, k] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
    return sums.reshape(len(stops), 64)


def fingerprints(texts: list[str | None], size: int = SIZE) -> np.ndarray:
    """The fingerprints of texts, as unsigned longs."""
    out = np.zeros(len(texts), dtype=np.uint64)
    plain = [b" ".join((t or "").encode().lower().split()) for t in texts]
    full = [k for k, t in enumerate(plain) if t]
    if not full:
        return out
    data = b" ".join(plain[k] for k in full)
    gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
    begins, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    words = np.array([plain[k].count(b" ") + 1 for k in full], dtype=np.int64)
    count = np.maximum(words - size + 1, 1)
    stops = np.cumsum(count)
    first = np.repeat(np.cumsum(words) - words, count) + np.arange(stops[-1]) - np.repeat(stops - count, count)
    last = first + np.repeat(np.minimum(words, size) - 1, count)
    start, length = begins[first], ends[last] - begins[first]
    hashes = np.concatenate([xxh64_spans(data, start[k : k + _CHUNK], length[k : k + _CHUNK]) for k in range(0, len(start), _CHUNK)])
    bits = 2 * _bit_sums(hashes, stops) > count[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and fp, a signed long, of every row of docs (doc_id, text)."""

    def run(batches):
        for b in portions(batches, most=1 << 20):
            texts = b.column("text").to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            found = fingerprints(list(place), size)[[place[t] for t in texts]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], schema=PRINT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def lookups(distance: int = DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, int, int, int]]:
    """(segment, offset, bits, flip) of every place that a fingerprint looks up; flip 0 is its own entry."""
    radius, rest = divmod(distance, segments)
    out, offset = [], 0
    for s in range(segments):
        bits = 64 // segments + (s >= segments - 64 % segments)
        for flips in range((radius if s <= rest else radius - 1) + 1):
            out += [(s, offset, bits, sum(1 << b for b in at)) for at in combinations(range(bits), flips)]
        offset += bits
    return out


def _looked_up(nodes: DataFrame, places: list[tuple[int, int, int, int]]) -> DataFrame:
    """key, fp, comp and entry for every place of every node."""
    listed = F.array(*[F.struct(F.lit(s << 60).cast("long").alias("s"), F.lit(o).alias("o"), F.lit((1 << b) - 1).cast("long").alias("m"), F.lit(x).cast("long").alias("x")) for s, o, b, x in places])
    at = nodes.select("fp", "comp", F.explode(listed).alias("p"))
    return at.select(F.expr("p.s | ((shiftrightunsigned(fp, p.o) & p.m) ^ p.x)").alias("key"), "fp", "comp", (F.col("p.x") == 0).alias("entry"))


def one_flip_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes (fp, comp) within two bits that tie all that such links tie: the nodes one flip from a common place.

    Fingerprints are distinct, so at most 65 of them meet in a place.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    places = nodes.select("comp", "fp", F.explode(flips).alias("f")).select("comp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
    met = places.groupBy("z").agg(F.min("comp").alias("a"), F.collect_list("comp").alias("all")).where("size(all) > 1")
    return met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked_within(groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between components, of rows (key, salt, role, fp, comp) with a (key, salt) in one task, sorted by role.

    Rows with role 0 are held, those with role 1 pass by.  Of the links that join the same components a task returns one.
    """

    def run(batches):
        above: dict[int, int] = {}

        def top(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        held = None
        for b in batches:
            key, salt, role, fp, comp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if held is not None:
                key, salt, role, fp, comp = (np.concatenate(x) for x in zip(held, (key, salt, role, fp, comp), strict=True))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            seekers = np.bincount(group, weights=role == 0).astype(np.int64)
            passing = np.flatnonzero((role == 1) & (seekers[group] > 0))
            upto = np.cumsum(seekers[group[passing]])
            found: list[tuple[int, int]] = []
            for part in np.split(passing, np.flatnonzero(np.diff(upto // _CHUNK)) + 1) if len(passing) else ():
                n = seekers[group[part]]
                one = np.repeat(part, n)
                other = np.repeat(start[group[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                near = (np.bitwise_count((fp[one] ^ fp[other]).view(np.uint64)) <= distance) & (comp[one] != comp[other])
                pairs = np.stack((np.minimum(comp[one[near]], comp[other[near]]), np.maximum(comp[one[near]], comp[other[near]])), axis=1)
                for x, y in np.unique(pairs, axis=0).tolist():
                    p, q = top(x), top(y)
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        found.append((x, y))
            last = slice(start[-1], start[-1] + seekers[-1]) if len(start) else slice(0, 0)
            held = tuple(x[last].copy() for x in (key, salt, role, fp, comp))
            if len(above) > 500_000:
                above.clear()
            cols = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=LINK)

    return groups.mapInArrow(run, "a long, b long").distinct()


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) that tie all nodes (fp, comp; both distinct) that chains of links within the distance tie."""
    places = lookups(distance, segments)
    own = [p for p in places if p[3] == 0]
    crowded = _looked_up(nodes, own).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = materialize(_looked_up(nodes, own).join(crowded, "key", "left_semi").select("fp", "comp").distinct())
    first = materialize(one_flip_links(heavy) if distance > 1 else heavy.select(F.col("comp").alias("a"), F.col("comp").alias("b")).where("a < b"))
    placed = nodes
    if first.limit(1).count():
        # each takes the least that it is linked with, and that one's least: what has one name is linked
        least = materialize(first.groupBy("b").agg(F.min("a").alias("c")))
        ahead = least.select(F.col("b").alias("c"), F.col("c").alias("further"))
        named = materialize(least.join(ahead, "c", "left").select(F.col("b").alias("comp"), F.coalesce("further", "c").alias("c")))
        placed = materialize(nodes.join(named, "comp", "left").select("fp", F.coalesce("c", "comp").alias("comp")))
    rows = _looked_up(placed, places)
    # values that very many look up: members of the largest component meet only those of others
    big = materialize(_looked_up(heavy, places).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SALT_ROWS).select("key"))
    plain = rows.join(big, "key", "left_anti")
    whole = plain.select("key", F.lit(0).alias("salt"), F.lit(1).alias("role"), "fp", "comp").unionByName(plain.where("entry").select("key", F.lit(0).alias("salt"), F.lit(0).alias("role"), "fp", "comp"))
    if big.limit(1).count():
        met = materialize(rows.join(big, "key", "left_semi").select("key", "fp", "comp"))
        parts = met.groupBy("key", "comp").agg(F.count("*").alias("n"))
        main = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), ((F.sum("n") - F.max("n")) / SALT_ROWS + 1).cast("int").alias("salts"), F.count("*").alias("n_parts"))
        met = met.join(materialize(main.where("n_parts > 1").select("key", "main", "salts")), "key")
        few = met.where("comp <> main").select("key", F.pmod(F.xxhash64("fp"), "salts").cast("int").alias("salt"), F.lit(0).alias("role"), "fp", "comp")
        every = met.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("role"), "fp", "comp")
        whole = whole.unionByName(few).unionByName(every)
    groups = whole.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    return materialize(first.unionByName(linked_within(groups, distance)))


def simhash_duplicates(docs: DataFrame, size: int = SIZE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text)."""
    prints = materialize(fingerprint_documents(docs, size))
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("comp"), F.count("*").alias("n")))
    # a doc_id may come again with another text: the fingerprint itself tells nodes of one doc_id apart
    links = fingerprint_links(nodes.select("fp", F.col("fp").alias("comp")), distance)
    least = components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialize(nodes.join(least, "fp", "left").select("fp", "comp", "n", F.coalesce("root", "fp").alias("root")))
    lowest = materialize(rooted.groupBy("root").agg(F.min("comp").alias("low"), F.sum("n").alias("rows")).where("rows > 1").drop("rows"))
    classes = materialize(rooted.join(lowest, "root").select("fp", F.col("low").alias("_component")))
    out = prints.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
    forget(nodes, rooted, lowest, links)
    return out


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
