"""Near-duplicate blocks a few places apart, by the longest common substring."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duplicate_string
from .loops import repetition_loops, turns_in_loops

KEY = "recording"
MIN_CHARS, MIN_SHARE, MAX_DISTANCE = 40, 0.5, 5
#: Neighbouring blocks that one task compares in a row, pieces of a text and places of them that are looked up before all windows are
#: hashed, and shares of the pairs from which the first are taken.
CELL_BLOCKS, MOST_PIECES, SHARES = 128, 64, 64


#: Base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Windows:
    """A text and the hashes of its windows of any length, by position."""

    def __init__(self, text: str, size: int) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        powers = np.full(n, BASE, np.uint64)
        self.back = np.full(n, INVERSE, np.uint64)
        powers[:1] = self.back[:1] = 1
        powers, self.back = np.cumprod(powers, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        x = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(32))) * powers, dtype=np.uint64)])
        self.first = np.unique(self.hashes(np.arange(n - size + 1), size))

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]


def found_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def longest_shared(a: Windows, b: Windows, least: int) -> int:
    """Length of the longest common substring, 0 where it is under least; equal hashes are confirmed on the texts."""
    if len(a.first) > len(b.first):
        a, b = b, a
    if not found_in(a.first, b.first).any():
        return 0

    def meet(pa: np.ndarray, pb: np.ndarray, size: int):
        pa, pb = pa[pa + size <= len(a.codes)], pb[pb + size <= len(b.codes)]
        if not len(pa) or not len(pb):
            return None
        ha, hb = a.hashes(pa, size), b.hashes(pb, size)
        ua, first_a = np.unique(ha, return_index=True)
        ub, first_b = np.unique(hb, return_index=True)
        both = found_in(ua, ub)
        for h, p in zip(ua[both], pa[first_a[both]], strict=True):
            q = pb[first_b[np.searchsorted(ub, h)]]
            if np.array_equal(a.codes[p : p + size], b.codes[q : q + size]):
                return pa[found_in(ha, ub)], pb[found_in(hb, ua)]
        return None

    places = meet(np.arange(len(a.codes)), np.arange(len(b.codes)), least)
    if places is None:
        return 0
    low, high = least, min(len(a.codes), len(b.codes))
    size = high
    while low < high:
        longer = meet(*places, size)
        if longer is None:
            high = size - 1
        else:
            low, places = size, longer
        size = (low + high + 1) // 2
    return low


class Text:
    """A text with its code points and windows, each made when first asked for."""

    def __init__(self, text: str, size: int) -> None:
        self.text, self.size, self._codes, self._windows = text, size, None, None

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._codes

    @property
    def windows(self) -> Windows:
        if self._windows is None:
            self._windows = Windows(self.text, self.size)
        return self._windows


def equal_steps(a: np.ndarray, b: np.ndarray) -> int:
    """How many places two arrays agree from their beginnings on."""
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    at = int(unlike.argmax()) if n else 0
    return at if n and unlike[at] else n


def shared_run(a: Text, b: Text, least: int) -> int:
    """As longest_shared().  A run of least characters holds a whole piece of the shorter text that begins at a multiple of a stride,
    so where such pieces and their places in the other text are few, each place is grown to both sides; else all windows are hashed.
    """
    if len(a.text) > len(b.text):
        a, b = b, a
    n = len(a.text)
    if n < least:
        return 0
    if a.text == b.text:
        return n
    piece = max(a.size, least // 2)
    stride = least - piece + 1
    if (n - piece) // stride >= MOST_PIECES:
        return longest_shared(a.windows, b.windows, least)
    longest, places, reached = 0, 0, {}
    for p in range(0, n - piece + 1, stride):
        wanted = a.text[p : p + piece]
        q = b.text.find(wanted)
        while q >= 0:
            if reached.get(q - p, 0) < p + piece:
                places += 1
                if places > MOST_PIECES:
                    return longest_shared(a.windows, b.windows, least)
                after = p + equal_steps(a.codes[p:], b.codes[q:])
                longest = max(longest, after - p + equal_steps(a.codes[:p][::-1], b.codes[:q][::-1]))
                reached[q - p] = after
            q = b.text.find(wanted, q + 1)
    return longest if longest >= least else 0


def shared_substrings(blocks: DataFrame, max_distance: int = MAX_DISTANCE, min_chars: int = MIN_CHARS, cross_speaker: bool = True, min_share: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (recording, i, j) of blocks (turn_idx, speaker, start, text) up to max_distance apart; the longest common substring of
    their duplicate_string()s is over min_chars and over min_share of the shorter one.  With its length, both speakers, starts and lengths,
    and the columns carry of both as <name>_i and <name>_j.

    Cells of CELL_BLOCKS neighbouring blocks and the max_distance blocks after them are dealt over tasks, and a task reads its cells in
    order with max_distance blocks at hand: few blocks are sent twice, and neither cells nor recordings are held.
    """
    size, width = min_chars + 1, max(CELL_BLOCKS, max_distance + 1)
    cells = F.array_distinct(F.array(F.floor((F.col("turn_idx") - max_distance) / width), F.floor(F.col("turn_idx") / width)))
    long = blocks.where((F.length("text") >= size) & F.col(KEY).isNotNull() & F.col("turn_idx").isNotNull())
    near = long.select(KEY, "turn_idx", "speaker", F.col("start").cast("double").alias("start"), "text", *carry, F.explode(cells).alias("_cell"))
    dealt = near.repartition(KEY, "_cell").sortWithinPartitions(KEY, "_cell", "turn_idx")
    kinds = dict(near.dtypes)
    fields = [KEY, "i", "j", "shared_chars", "first_speaker", "second_speaker", "start", "start_j", "length_i", "length_j", *[f"{c}_{k}" for k in "ij" for c in carry]]
    types = [kinds[KEY], kinds["turn_idx"], kinds["turn_idx"], "long", "string", "string", "double", "double", "long", "long", *[kinds[c] for c in carry] * 2]
    names = [KEY, "_cell", "turn_idx", "speaker", "start", "text", *carry]

    def run(batches):
        cell, recent = None, deque()
        for batch in batches:
            out: list[tuple] = []
            for key, at, turn, speaker, start, raw, *more in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (key, at) != cell:
                    cell = (key, at)
                    recent.clear()
                while recent and turn - recent[0][0] > max_distance:
                    recent.popleft()
                norm = duplicate_string(raw)
                if len(norm) < size:
                    continue
                text = Text(norm, size)
                for turn_x, speaker_x, start_x, text_x, more_x in recent:
                    if turn_x == turn or (cross_speaker and (speaker_x is None or speaker is None or speaker_x == speaker)):
                        continue
                    least = max(size, int(min_share * min(len(norm), len(text_x.text))) + 1)
                    n = shared_run(text_x, text, least)
                    if n:
                        out.append((key, turn_x, turn, n, speaker_x, speaker, start_x, start, len(text_x.text), len(norm), *more_x, *more))
                if turn // width == at:
                    recent.append((turn, speaker, start, text, more))
            of = lambda c: batch.schema.field(c).type  # noqa: E731, B023
            arrow = [of(KEY), of("turn_idx"), of("turn_idx"), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[of(c) for c in carry] * 2]
            columns = zip(*out, strict=True) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=fields)

    return dealt.select(names).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(fields, types, strict=True)))


def near_duplicates(turns: DataFrame, max_distance: int = MAX_DISTANCE, min_chars: int = MIN_CHARS, min_share: float = MIN_SHARE, cross_speaker: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose shared run is over min_chars and over min_share of the shorter text, with both blocks' columns, and the columns carry
    of both as <name>_i and <name>_j."""
    pairs = shared_substrings(turns, max_distance, min_chars, cross_speaker, min_share, carry)
    kept = pairs.where(F.col("shared_chars") > min_share * F.least("length_i", "length_j"))
    return kept.select(KEY, "i", "j", (F.col("j") - F.col("i")).alias("distance"), "first_speaker", "second_speaker", (F.col("first_speaker") == F.col("second_speaker")).alias("same_speaker"), "start", (F.col("start_j") - F.col("start")).alias("delta_seconds"), "shared_chars", *[f"{c}_{k}" for k in "ij" for c in carry])


def cross_speaker_duplicates(turns: DataFrame, loop_threshold: int = 10) -> DataFrame:
    """near_duplicates() of two speakers, without blocks inside repetition loops; the others keep their places.

    Pairs lose those blocks, and not the blocks their texts, which so are not sent once more.
    """
    looped = turns_in_loops(turns, repetition_loops(turns, loop_threshold))
    pairs = near_duplicates(turns)
    for place in "ij":
        pairs = pairs.join(looped.withColumnRenamed("turn_idx", place), [KEY, place], "left_anti")
    return pairs.select(KEY, "i", "j", "distance", "first_speaker", "second_speaker", "same_speaker", "start", "delta_seconds", "shared_chars")


def top_duplicates(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The first k pairs by start, for the warning, with n_more: how many pairs there are besides.

    The pairs are found once: shares of them are counted and give their first k, of which the first k are taken.
    """
    order = ["start", KEY, "distance", "i"]
    share = Window.partitionBy("_share")
    dealt = pairs.withColumn("_share", F.pmod(F.xxhash64(KEY, "i", "j"), F.lit(SHARES)))
    first = dealt.withColumns({"_n": F.count("*").over(share), "_at": F.row_number().over(share.orderBy(*order))}).where(F.col("_at") <= k)
    every = Window.partitionBy(F.lit(1))
    total = F.sum(F.when(F.col("_at") == 1, F.col("_n"))).over(every)
    top = first.withColumns({"n_more": F.greatest(F.lit(0), total - k), "_place": F.row_number().over(every.orderBy(*order))}).where(F.col("_place") <= k)
    return top.orderBy("start", KEY, "distance", "i").select(*pairs.columns, "n_more")
