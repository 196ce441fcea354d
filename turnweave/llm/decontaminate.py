"""Operator 5: benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words (runs of letters, digits and underscores) with single spaces, and with a space
before the first and after the last word of text and item, so that an item does not occur inside a word for nothing.  An item
of m characters may occur with up to k = floor(ERROR_RATE * m) edits, of which these spaces may take some.  At an end of an item whose letter belongs to a
script without spaces between words (Chinese, Japanese, Thai and others) there is no such space: such an item may begin or end inside a run
of letters.  An item is split into k + 1 pieces; k edits leave
at least one piece untouched, so an Aho-Corasick automaton of all pieces finds every candidate place, and Myers'
bit-parallel distance decides it exactly.

Defined results: null and empty texts and items match nothing; an item id that repeats counts with each of its
texts; there is one row for each doc_id and item_id, with the smallest distance over all rows of either id, whatever the
size of the benchmark; an empty table on either side gives no rows.  Extra columns are not read.  The benchmark is read in
blocks of BLOCK_CHARS characters, one after another, and each block is sent to all workers, so no automaton grows with it;
documents are read once and pass by all blocks, one step of the same stage for each.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")
#: Blocks of scripts that put no spaces between words (Thai to Tibetan, Myanmar, Khmer, kana, Han).
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalized(text: str | None) -> str:
    """Words with a space before and after each; empty without words."""
    words = " ".join(WORD.findall((text or "").lower()))
    return words and f" {words} "


def pattern_of(text: str | None) -> tuple[str, int]:
    """An item as it is looked for, and how many characters count for its budget."""
    t = normalized(text)
    if not t:
        return "", 0
    start, end = (1 if UNSPACED.match(t[1]) else 0), (1 if UNSPACED.match(t[-2]) else 0)
    return t[start : len(t) - end], len(t) - 2


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of nearly equal length."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(pattern: str, masks: dict[str, int], text: str) -> int:
    """Smallest edit distance of pattern to any part of text: one column of bits a text character."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up = minus | ~(d | plus) & ones
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up = up << 1 & ones  # a match may begin at any place of the text
        down = down << 1 & ones
        plus = down | ~(x | up) & ones
        minus = up & x
    return best


class ItemIndex:
    """Automaton of all pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items, found = [], {}
        for item_id, text in items:
            t, counted = pattern_of(text)
            if not t:
                continue
            k, i = int(error_rate * counted), len(self.items)
            masks: dict[str, int] = {}
            for j, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << j
            self.items.append((item_id, t, k, masks))
            for offset, p in pieces(t, k):
                found.setdefault(p, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for p, places in found.items():
            self.automaton.add_word(p, (len(p), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> dict[int, int]:
        """Item id -> smallest distance, for items within their budget."""
        body = normalized(text)
        if not body or not self.items:
            return {}
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(body):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - n - offset)
        out: dict[int, int] = {}
        for i, at in starts.items():
            item_id, item, k, masks = self.items[i]
            low = high = None
            windows = []
            for s in sorted(at):  # places whose windows meet are tried together
                a, b = max(0, s - k), min(len(body), s + len(item) + k)
                if high is not None and a <= high and b - low <= 4 * (len(item) + 2 * k):
                    high = b
                    windows[-1] = (low, high)
                else:
                    low, high = a, b
                    windows.append((a, b))
            best = k + 1
            for a, b in windows:
                part = body[a:b]
                best = 0 if item in part else min(best, best_distance(item, masks, part))
                if not best:
                    break
            if best <= k:
                out[item_id] = min(best, out.get(item_id, best))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Lists of (item_id, text) of about block_chars characters, read one after another."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id and distance of every benchmark item that occurs in a document within its budget of edits."""
    spark = docs.sparkSession
    kind = "doc_id long, text string, items array<long>, distances array<long>"
    lists = pa.list_(pa.int64())

    def matcher(shared):
        def run(batches):
            index = ItemIndex(shared.value, error_rate)
            for b in portions(batches):
                met = [index.matches(t) for t in b.column("text").to_pylist()]
                items = [x + list(m) for x, m in zip(b.column("items").to_pylist(), met, strict=True)]
                distances = [x + list(m.values()) for x, m in zip(b.column("distances").to_pylist(), met, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(items, lists), pa.array(distances, lists)], names=["doc_id", "text", "items", "distances"])

        return run

    none = F.array().cast("array<long>")
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), none.alias("items"), none.alias("distances"))
    for block in item_blocks(benchmark, block_chars):
        read = read.mapInArrow(matcher(spark.sparkContext.broadcast(block)), kind)
    met = read.select("doc_id", F.explode(F.arrays_zip("items", "distances")).alias("m")).select("doc_id", F.col("m.items").alias("item_id"), F.col("m.distances").alias("distance"))
    return met.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns unchanged, in whose text no item occurs within its budget; no shuffle."""
    for block in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = ItemIndex(shared.value, error_rate)
            for b in portions(batches):
                yield b.filter(pa.array([not index.matches(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
