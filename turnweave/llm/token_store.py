"""Operator 7: content-addressed store of token ids.

The ids of all documents, in ascending doc_id order, form one stream.  A rolling hash over the ids cuts each
document's ids into chunks; a chunk is stored once, under the digest of its bytes.  A recipe row for every
document lists its chunk digests in order, with the Merkle root over these digests.  Reading joins recipes
to chunks, checks every digest and every root, and puts the ids together again.

Files (all Parquet, below one folder):
  chunks/  digest binary (of the little-endian unsigned 32-bit ids), data binary (a byte that says how many bytes an id
           takes, 2 or 4, and the ids so written, packed with zstandard)
  recipes/ doc_id, start, n_tokens, chunk_digests array<binary>, merkle_root binary; sorted by doc_id, so the
           files in name order give the stream in ascending doc_id order

Defined results: a null or empty text holds only the end id; a document's chunks never span two documents;
equal texts share all their chunks.  Rows with one doc_id repeated keep their count and are ordered by their
Merkle root.  An empty table gives empty files.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PORTION_BYTES, SpacedEncoder, byte_alphabet, cuts_at_spaces, default_vocabulary
from .common import forget, materialize, mix, portions, scratch_dir, table

END_ID = 2
#: Cut where the upper MASK_BITS bits of the hash of the last WINDOW ids (a power of two) are zero; chunks hold MIN_IDS to
#: MAX_IDS ids.
WINDOW, MASK_BITS, MIN_IDS, MAX_IDS = 8, 10, 256, 8192
_BASE = 0x9E3779B97F4A7C15
#: mix() of the ids of usual vocabularies.
_MIXED = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: Words remembered by one worker.
WORDS_KEPT = 800_000
#: Words of one row that the library is asked for.
ROW_WORDS = 2000


class LibraryEncoder(SpacedEncoder):
    """The tokenizers library, asked once for each distinct pre-token that a worker remembers.

    Other kinds of vocabulary than byte-level ones with the usual pattern get whole texts only.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(sorted(t.content for t in self.library.get_added_tokens_decoder().values()), WORDS_KEPT)
        self.cuttable = cuts_at_spaces(json.loads(self.library.to_str()))
        if self.cuttable:
            alphabet = byte_alphabet()
            self.sizes = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
            for token, i in self.library.get_vocab(with_added_tokens=False).items():
                self.sizes[i] = len(bytes(map(alphabet.__getitem__, token)))

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, words: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ask(words)]

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Words are asked for in rows: each begins a pre-token.  The ids of a row are cut where the bytes of its words end."""
        out: list[bytes] = []
        for at in range(0, len(words), ROW_WORDS):
            text = " " + " ".join(words[at : at + ROW_WORDS])
            data = text.encode()
            ids = np.array(self._ask([text])[0], dtype="<u4")
            ends = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)[1:], len(data))
            stops = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def ids_of_whole(self, text: str) -> bytes:
        return array("I", self._ask([text])[0]).tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.cuttable:
            return super().encode_column(texts)
        ids = self._ask(pc.fill_null(texts, "").to_pylist())
        return np.array([len(x) for x in ids], dtype=np.int64), np.array([i for x in ids for i in x], dtype="<u4")


_LOADED: dict[str, LibraryEncoder] = {}


def library(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def cut_points(ids: np.ndarray) -> list[int]:
    """End positions of the chunks of an id stream; they depend on nearby ids only."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    # a polynomial of the last WINDOW ids, put together from halves
    rolled, have, base = _MIXED[ids] if ids.max() < len(_MIXED) else mix(ids.astype(np.uint64) + np.uint64(1)), 1, _BASE
    while have < WINDOW:
        rolled = rolled[:-have] * np.uint64(base) + rolled[have:]
        have, base = 2 * have, base * base & 0xFFFFFFFFFFFFFFFF
    hits = np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    cuts, start = [], 0
    for h in hits.tolist():
        while h - start > MAX_IDS:
            start += MAX_IDS
            cuts.append(start)
        if h - start >= MIN_IDS:
            cuts.append(h)
            start = h
    while n - start > MAX_IDS:
        start += MAX_IDS
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def packed(ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """A chunk as it is stored: two bytes an id if all ids fit."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + pack.compress(ids.astype(f"<u{width}").tobytes())


def unpacked(data: bytes, unpack: zstandard.ZstdDecompressor) -> bytes:
    """The little-endian unsigned 32-bit ids of a stored chunk."""
    return np.frombuffer(unpack.decompress(data[1:]), dtype=f"<u{data[0]}").astype("<u4").tobytes()


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged; leaves and nodes hash under different prefixes."""
    level = [hashlib.blake2b(b"\x00" + d, digest_size=16).digest() for d in digests]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


CUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk_digests", pa.list_(pa.binary())), ("merkle_root", pa.binary()), ("chunks", pa.list_(pa.binary()))])


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, chunk_digests, merkle_root and the compressed chunks that this portion of rows met first."""

    def run(batches):
        lib, pack = library(vocabulary), zstandard.ZstdCompressor(level=1)
        for b in portions(batches, most=PORTION_BYTES):
            seen: set[bytes] = set()
            n, names, roots, datas = [], [], [], []
            counts, stream = lib.encode_column(b.column("text"))
            for part in np.split(stream, np.cumsum(counts)[:-1]):
                ids = np.append(part, np.uint32(end_id)).astype("<u4", copy=False)
                raw = ids.tobytes()
                ds, new, start = [], [], 0
                for end in cut_points(ids):
                    piece = raw[4 * start : 4 * end]
                    d = hashlib.blake2b(piece, digest_size=16).digest()
                    ds.append(d)
                    if d not in seen:
                        seen.add(d)
                        new.append(packed(ids[start:end], pack))
                    else:
                        new.append(None)
                    start = end
                n.append(len(ids))
                names.append(ds)
                roots.append(merkle_root(ds))
                datas.append(new)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(datas, pa.list_(pa.binary()))], schema=CUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, chunk_digests array<binary>, merkle_root binary, chunks array<binary>")


def running_start(counts: DataFrame) -> DataFrame:
    """counts (doc_id, n_tokens, merkle_root and more) with start: tokens of all rows before, in (doc_id, root) order.

    Rows are dealt by ranges of doc_id; each range is summed by itself, and only one row a range meets in one place.
    """
    order = ["doc_id", "merkle_root"]
    ranged = materialize(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside - F.col("n_tokens")).join(before, "_range").withColumn("start", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write chunks/ and recipes/ of docs (doc_id, text) below folder."""
    cut = materialize(cut_documents(docs, vocabulary or default_vocabulary(), end_id), compression="none", batch_bytes=PORTION_BYTES)
    met = cut.select(F.explode(F.arrays_zip("chunk_digests", "chunks")).alias("c")).select(F.col("c.chunk_digests").alias("digest"), F.col("c.chunks").alias("data")).where("data is not null")
    met.dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{folder}/chunks")
    started = running_start(cut.select("doc_id", "n_tokens", "chunk_digests", "merkle_root"))
    started.select("doc_id", "start", "n_tokens", "chunk_digests", "merkle_root").orderBy("doc_id", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    forget(cut)


READ = pa.schema([("merkle_root", pa.binary()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_store(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """merkle_root, n_ids, ids_crc32 and (keep_ids) ids, little-endian unsigned 32 bits, of every distinct id list.

    Fails if a chunk is missing or differs from its digest, or a list from its Merkle root.
    """
    recipes = spark.read.parquet(f"{folder}/recipes").select("merkle_root", "chunk_digests").dropDuplicates(["merkle_root"])
    chunks = spark.read.parquet(f"{folder}/chunks")
    parts = recipes.select("merkle_root", F.size("chunk_digests").alias("n_chunks"), F.posexplode("chunk_digests").alias("seq", "digest"))
    found = parts.join(chunks, "digest", "left").select("merkle_root", "n_chunks", "seq", "digest", "data")
    ordered = found.repartition("merkle_root").sortWithinPartitions("merkle_root", "seq")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        root, names, datas, want = None, [], [], 0

        def finish():
            if merkle_root(names) != root or len(names) != want:
                raise ValueError(f"token store: the chunks of {root.hex()} do not give its root")
            ids = b"".join(datas)
            return root, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else b""

        for b in batches:
            out = []
            for r, n, d, data in zip(*(b.column(c).to_pylist() for c in ("merkle_root", "n_chunks", "digest", "data")), strict=True):
                if r != root:
                    if root is not None:
                        out.append(finish())
                    root, names, datas, want = r, [], [], n
                if data is None:
                    raise ValueError(f"token store: no chunk {d.hex()}")
                raw = unpacked(data, unpack)
                if hashlib.blake2b(raw, digest_size=16).digest() != d:
                    raise ValueError(f"token store: chunk {d.hex()} is damaged")
                names.append(d)
                datas.append(raw)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), READ.types, strict=True)], schema=READ)
        if root is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finish(), READ.types, strict=True)], schema=READ)

    return ordered.mapInArrow(run, "merkle_root binary, n_ids long, ids_crc32 long, ids binary")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    write_store(table(spark, sf_dir, "documents"), folder)
    back = read_store(spark, folder, keep_ids=False)
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "merkle_root")
    return recipes.join(back, "merkle_root").select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
