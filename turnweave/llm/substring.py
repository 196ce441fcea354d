"""Operator 2: removal of recurring passages with sharded phrase automata.

A window is WINDOW consecutive words.  Its anchor is the least hash of the GRAM-word runs inside it, so equal
windows have equal anchors, and about one word in eighteen is an anchor.

1. Anchors that occur in two documents or more are found by aggregation over (anchor, doc_id).
2. The windows at such anchors are hashed and aggregated; a window of two documents or more is confirmed, and its
   owner is the least doc_id that holds it.
3. Owners give the words of their confirmed windows, as passages of at most PASSAGE_WORDS words.
4. Documents are dealt into shards of about SHARD_BYTES bytes.  A shard gets the passages whose anchors occur in it, and
   compiles them into Aho-Corasick automata (over words, AUTOMATON_WORDS words each): the patterns are runs of half a
   window, of which every window of a passage holds one.  All documents of the shard stream through those automata with
   whose passages they have an anchor in common (they hold no window of the others); each hit is extended word by word,
   and a common run of WINDOW words or more with a passage of a smaller doc_id is removed.

Hashes only choose candidates and owners (128 bits a window); what is removed has been compared word by word.  No step gathers the documents of
one anchor: counts are aggregated before the shuffle, and a passage reaches a shard once, however often it occurs there.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; passages within one
document are no duplicates; equal texts lose all windows but in the least doc_id; rows that repeat a doc_id count as
one document and each get a result; rows with a null doc_id own nothing and lose nothing.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SHARD_BYTES, forget, gram_hashes, hashed_words, materialize, mix, portions, shard_count, signed, table

WINDOW, GRAM = 50, 16
PASSAGE_WORDS, AUTOMATON_WORDS = 400, 200_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Windows:
    """Anchors and hashes of the windows of one text, by start word."""

    def __init__(self, data: bytes, window: int):
        self.words = hashed_words(data)
        self.window = window
        n = len(self.words) - window + 1
        gram = min(GRAM, window)
        self.anchors = sliding_min(gram_hashes(self.words, gram), window - gram + 1) if n > 0 else np.empty(0, np.uint64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all windows, put together from the hashes of runs of GRAM words and of the rest."""
        parts, at, size = [], 0, self.window
        while size:
            g = min(GRAM, size)
            parts.append((at, g))
            at, size = at + g, size - g
        n = len(self.anchors)
        made = {g: gram_hashes(self.words, g, seed=1) for _, g in parts}
        out = []
        for seed in (1, 2):
            total = np.zeros(n, dtype=np.uint64)
            for i, (at, g) in enumerate(parts):
                total += made[g][at : at + n] * (mix(np.array([977 * seed + i + 1], dtype=np.uint64))[0] | np.uint64(1))
            out.append(mix(total))
        return out[0], out[1]


def shard_of(doc_id: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for b in portions(batches):
            ids, found = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                a = np.unique(Windows((t or "").encode(), window).anchors)
                if len(a):
                    ids.append(d)
                    found.append(signed(a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, anchors array<long>")


def by_document(t: pa.Table, key: str, value: str) -> dict[int, np.ndarray]:
    """key -> sorted values, of a table of two long columns."""
    if not t.num_rows:
        return {}
    t = t.sort_by([(key, "ascending"), (value, "ascending")])
    k, v = t.column(key).to_numpy(), t.column(value).to_numpy()
    cut = np.flatnonzero(np.diff(k)) + 1
    return dict(zip(k[np.concatenate(([0], cut))].tolist(), np.split(v, cut), strict=True))


def _in_sorted(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


HASHED = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64())])


def candidate_windows(sharded: DataFrame, routed: DataFrame, window: int) -> DataFrame:
    """h, g and doc_id of the windows whose anchor recurs."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        known = np.sort(anchors.column("anchor").to_numpy())
        out: list[list[np.ndarray]] = [[], [], []]
        if len(known):
            for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
                if d is None:
                    continue
                w = Windows((t or "").encode(), window)
                hit = _in_sorted(signed(w.anchors), known)
                if hit.any():
                    h, g = (signed(x)[hit] for x in w.hashes())
                    h, first = np.unique(h, return_index=True)
                    out[0].append(h)
                    out[1].append(g[first])
                    out[2].append(np.full(len(h), d, dtype=np.int64))
        cols = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in out]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=HASHED)

    return sharded.groupBy("shard").cogroup(routed.select("shard", "anchor").groupBy("shard")).applyInArrow(run, "h long, g long, doc_id long")


PASSAGES = pa.schema([("owner", pa.int64()), ("at", pa.int64()), ("passage", pa.string()), ("anchors", pa.list_(pa.int64()))])


def owned_passages(sharded: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """owner, at, passage (words with one space between) and anchors of the confirmed windows, as runs in their owners."""

    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        known = by_document(windows.select(["owner", "h"]), "owner", "h")
        rows = []
        for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            if d not in known:
                continue
            data = (t or "").encode()
            w = Windows(data, window)
            hit = _in_sorted(signed(w.hashes()[0]), known[d])
            edge = np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            words = data.split()
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                step = PASSAGE_WORDS - window + 1
                for s in range(a, b, step):
                    e = min(s + step, b)
                    rows.append((d, s, b" ".join(words[s : e + window - 1]).decode(), signed(np.unique(w.anchors[s:e]))))
        cols = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(cols, PASSAGES.types, strict=True)], schema=PASSAGES)

    return sharded.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(run, "owner long, at long, passage string, anchors array<long>")


def same_run(a: str, i: int, b: str, j: int) -> int:
    """Length of the common run of a from i and b from j."""
    n = min(len(a) - i, len(b) - j)
    if a[i : i + n] == b[j : j + n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[i : i + mid] == b[j : j + mid]:
            low = mid
        else:
            high = mid
    return low


class PhraseAutomaton:
    """Passages as strings of digits, and an automaton of their half-window runs.

    A word is its number in the passages' vocabulary, written with a fixed count of digits of base 16; the first digit has
    symbols of its own, so that matches begin at words, and no node of the automaton has over 16 branches (the library
    searches branches one by one).  Numbers are given by word hashes, without a loop over the words of a document; runs
    that are found are compared as words before they count.
    """

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        self.window, self.half = window, max(1, window // 2)
        self.owners = [o for o, _ in passages]
        self.words = [p.split() for _, p in passages]
        hashes = [hashed_words(p) for _, p in passages]
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.digits = max(1, -(-len(self.vocabulary).bit_length() // 4))
        self.texts = [self.translate(h) for h in hashes]
        self.backward = [t[::-1] for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        size = self.half * self.digits
        for i in sorted(range(len(passages)), key=self.owners.__getitem__):
            t = self.texts[i]
            for off in range(0, len(t) - size + 1, size):
                places.setdefault(t[off : off + size], []).append((self.owners[i], i, off))
        for phrase, at in places.items():
            self.automaton.add_word(phrase, at)
        self.automaton.make_automaton()

    def translate(self, hashes: np.ndarray) -> str:
        """self.digits symbols a word; words outside the vocabulary have a number of their own, 0."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        number = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        shown = np.empty((len(number), self.digits), dtype=np.uint8)
        for k in range(self.digits):
            shown[:, k] = (number >> (4 * (self.digits - 1 - k)) & 15) + (97 if k else 65)
        shown[number == 0] = 48
        return shown.tobytes().decode("ascii")

    def mark(self, doc_id: int, hashes: np.ndarray, words: Callable[[], list[bytes]], covered: bytearray) -> None:
        """Set covered where a passage of a smaller doc_id has a whole window in common with the words.

        A hit whose every window is covered already adds nothing and is passed over, so a text that many passages share
        costs no more than one of them.
        """
        s, k = self.translate(hashes), self.digits
        n, size, back = len(s), self.half * self.digits, None
        reach = self.window - self.half
        done: dict[tuple[int, int], int] = {}
        for end, at in self.automaton.iter(s):
            p = end + 1 - size
            w = p // k
            low, high = max(0, w - reach), w + self.window
            if covered.find(0, low, high) < 0:
                continue
            for owner, i, off in at:
                if owner >= doc_id:
                    break
                key = (i, p - off)
                if done.get(key, -1) > p:
                    continue
                if back is None:
                    back = s[::-1]
                t = self.texts[i]
                right = same_run(s, p, t, off) // k
                left = same_run(back, n - p, self.backward[i], len(t) - off) // k
                done[key] = p + right * k
                a, b = w - left, off // k - left
                if left + right >= self.window and words()[a : a + left + right] == self.words[i][b : b + left + right]:
                    covered[a : a + left + right] = b"\x01" * (left + right)
                    if covered.find(0, low, high) < 0:
                        break


def blocks_of(passages: list[bytes]) -> list[int]:
    """The automaton, of about AUTOMATON_WORDS words, that each passage goes to."""
    words = np.cumsum([p.count(b" ") + 1 for p in passages])
    return ((words - 1) // AUTOMATON_WORDS).tolist()


KEPT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def cached_split(data: bytes) -> Callable[[], list[bytes]]:
    """The words of data, split when first asked for."""
    made: list[list[bytes]] = []

    def words() -> list[bytes]:
        if not made:
            made.append(data.split())
        return made[0]

    return words


def stream_shards(sharded: DataFrame, passages: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Result rows of all documents of every shard, with their other columns."""
    fields = [f for f in sharded.schema.fields if f.name not in ("shard", "text")]

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").to_pylist()
        datas = [(t or "").encode() for t in docs.column("text").to_pylist()]
        covered: list[bytearray | bytes] = [b""] * len(ids)
        if phrases.num_rows:
            phrases = phrases.sort_by([("owner", "ascending"), ("at", "ascending")])
            known = list(zip(phrases.column("owner").to_pylist(), [p.encode() for p in phrases.column("passage").to_pylist()], strict=True))
            block = blocks_of([p for _, p in known])
            anchors = phrases.column("anchors").combine_chunks()
            values = anchors.flatten().to_numpy()
            of_value = np.repeat(block, anchors.value_lengths().to_numpy())
            order = np.argsort(values, kind="stable")
            values, of_value = values[order], of_value[order]
            visits: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k, (d, x) in enumerate(zip(ids, datas, strict=True)):
                w = Windows(x, window)
                if d is None or not len(w.anchors):
                    continue
                own = np.unique(signed(w.anchors))
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                met = {int(i) for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True) for i in of_value[a:b]}
                for i in met:
                    visits.setdefault(i, []).append((k, w.words))
                if met:
                    covered[k] = bytearray(len(w.words))
            for i in sorted(visits):
                a = PhraseAutomaton(known[bisect_left(block, i) : bisect_right(block, i)], window)
                for k, hashes in visits[i]:
                    a.mark(ids[k], hashes, cached_split(datas[k]), covered[k])
        rows = []
        for k, x in enumerate(datas):
            w = x.split()
            c = covered[k]
            n = sum(c)
            kept = b" ".join(w if not n else [x for x, gone in zip(w, c, strict=True) if not gone])
            rows.append((len(w), n, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text and n else None))
        cols = zip(*rows, strict=True) if rows else ((),) * 4
        found = dict(zip(KEPT.names, (pa.array(c, t) for c, t in zip(cols, KEPT.types, strict=True)), strict=True))
        if keep_text:
            found["text"] = pc.if_else(pc.greater(found["n_removed"], 0), found["text"], docs.column("text").combine_chunks())
        return pa.table({f.name: docs.column(f.name) for f in fields} | found)

    schema = StructType(fields + [StructField(n, LongType() if t == pa.int64() else StringType()) for n, t in zip(KEPT.names, KEPT.types, strict=True)])
    return sharded.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns carry, n_words, n_removed, kept_sha256 and (keep_text) text of every row of docs (doc_id, text).

    A text that loses nothing stays as it is; of others the kept words remain, with one space between them.
    """
    other = docs.select(F.col("doc_id").cast("long"), *carry, F.col("text").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = shard_count(docs, shard_bytes=shard_bytes)
    sharded, carried = (x.withColumn("shard", shard_of("doc_id", shards)) for x in (docs, other))

    anchors = materialize(document_anchors(docs, window))
    placed = anchors.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = placed.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    routed = materialize(placed.join(recurring, "anchor").groupBy(shard_of("doc_id", shards).alias("shard"), "anchor").agg(F.max("doc_id").alias("most")))

    hashed = candidate_windows(sharded, routed, window)
    counted = hashed.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most")
    confirmed = materialize(counted.select("owner", "h").withColumn("shard", shard_of("owner", shards)))
    passages = materialize(owned_passages(sharded, confirmed, window))
    forget(confirmed, anchors)

    goes = passages.select("owner", "at", F.explode("anchors").alias("anchor")).join(routed, "anchor").where("owner < most").select("owner", "at", "shard").distinct()
    dealt = goes.join(passages, ["owner", "at"]).select("shard", "owner", "at", "passage", "anchors")
    return stream_shards(carried, dealt, window, keep_text)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
windows AS (
  SELECT doc_id, i AS first, array_to_string(list_slice(words, i, i + 49), ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)
),
owners AS (SELECT w, min(doc_id) AS owner FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + 50)) AS k
  FROM windows JOIN owners USING (w) WHERE owner < doc_id
),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM texts),
kept AS (
  SELECT n.doc_id, string_agg(n.word, ' ' ORDER BY n.k) FILTER (WHERE g.k IS NULL) AS text, count(g.k) AS n_removed
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.k = g.k GROUP BY n.doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
