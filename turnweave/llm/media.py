"""Operator 6: media columns kept as content-defined chunks.

A payload of 8-bit samples gets a WAV header.  The header stays in the recipe row; a rolling gear hash cuts
the samples into chunks.  A Spark aggregation over chunk digests keeps one copy of each chunk, in a table
bucketed by digest (packed with a dictionary that the table <chunks>_dictionary keeps), and a recipe row lists the digests of each distinct payload in order.  Reading back joins
recipes with chunks, checks every digest, the length, and the root digest over header, byte count and digests in their
order, and puts the file together.

Defined results: a null or empty text becomes one block of padding; equal texts have equal recipes and are
rebuilt once; rows with a repeated doc_id (or none) each get a result.  An empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, least_hashes, materialize, mix, portions, shard_count, table, writing

#: A cut where the upper CUT_BITS of the gear hash are zero; chunks hold MIN_CHUNK to MAX_CHUNK bytes.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 512, 65536
BLOCK, PAD, RATE = 576, 255, 8000
#: Chunks are packed with a shared dictionary, built from at most DICT_TEXTS texts, a piece of DICT_SAMPLE characters of each.
DICT_TEXTS, DICT_SAMPLE, DICT_BYTES, LEVEL = 1500, 4096, 112_640, 19
#: Bytes of text for each bucket of the chunk table.
BUCKET_BYTES = 16 << 20
#: One pseudo-random number a byte value, made by rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text in UTF-8 padded to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (-len(raw) % BLOCK if raw else BLOCK)


def wav_header(n: int) -> bytes:
    """RIFF header of n unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def cut_points(data: bytes) -> list[int]:
    """Chunk ends.  The gear hash h = 2h + GEAR[byte] is taken modulo 2**16, so 16 bytes decide it; three doublings build it."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k)
        h = h + shifted
    cuts, start = [], 0
    for end in (np.flatnonzero((h >> np.uint16(16 - CUT_BITS)) == 0) + 1).tolist():
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            cuts.append(start)
        if end - start >= MIN_CHUNK:
            cuts.append(end)
            start = end
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def features(samples: np.ndarray) -> str:
    """Level, energy and zero crossings of 8-bit samples, from whole-number sums."""
    x = samples.astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};crossings={crossings};peak={int(np.abs(x).max())}"


RECIPE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("root", pa.binary()), ("header", pa.binary()), ("digests", pa.list_(pa.binary()))])
CHUNKS = pa.schema([("digest", pa.binary()), ("data", pa.binary())])


def _pieces(payload: bytes):
    start = 0
    for end in cut_points(payload):
        yield payload[start:end]
        start = end


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _root(header: bytes, n_bytes: int, digests: list[bytes]) -> bytes:
    return _digest(header + str(n_bytes).encode() + b"".join(digests))


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def recipes_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in portions(batches):
            rows = []
            for t in b.column("text").to_pylist():
                n, payload = payload_of(t)
                header = wav_header(len(payload))
                ds = [_digest(p) for p in _pieces(payload)]
                rows.append((n, _root(header, n, ds), header, ds))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, RECIPE.types[1:], strict=True))], schema=RECIPE)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, root binary, header binary, digests array<binary>")


def shared_dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample, the texts with the smallest hash of id and text; empty for few texts.

    Long texts give a piece from a place that the hash chooses.  Payloads are stored whole whatever the dictionary is.
    """
    h = F.xxhash64("doc_id", "text")
    place = 1 + F.pmod(h, F.greatest(F.char_length("text") - DICT_SAMPLE, F.lit(1)))
    some = least_hashes(docs.where("text is not null"), h, DICT_TEXTS).select(h.alias("h"), F.col("text").substr(place.cast("int"), F.lit(DICT_SAMPLE)).alias("t")).distinct()
    texts = [r["t"].encode() for r in sorted(some.collect(), key=lambda r: (r["h"], r["t"]))[:DICT_TEXTS]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, texts)) // 10), texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def chunks_of(docs: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """digest and packed data of the chunks, once for each portion of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_dict_id=False)
        for b in portions(batches):
            found: dict[bytes, bytes] = {}
            for t in b.column("text").to_pylist():
                for p in _pieces(payload_of(t)[1]):
                    d = _digest(p)
                    if d not in found:
                        found[d] = pack.compress(p)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], schema=CHUNKS)

    return docs.mapInArrow(run, "digest binary, data binary")


def write_media(docs: DataFrame, chunk_table: str) -> DataFrame:
    """Store docs (doc_id, text): chunks go to the table chunk_table, the recipes are returned."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    recipes = materialize(recipes_of(docs))
    buckets = max(8, shard_count(docs, shard_bytes=BUCKET_BYTES))
    dictionary = shared_dictionary(docs)
    spark = docs.sparkSession
    spark.createDataFrame([(dictionary,)], "dictionary binary").coalesce(1).write.format("parquet").saveAsTable(f"{chunk_table}_dictionary")
    unique = chunks_of(docs, dictionary).repartition(buckets, "digest").dropDuplicates(["digest"])
    with writing(spark):
        unique.write.option("compression", "none").bucketBy(buckets, "digest").format("parquet").saveAsTable(chunk_table)
    return recipes


MEDIA = pa.schema([("root", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])


def read_media(recipes: DataFrame, chunk_table: str, keep_media: bool = True) -> DataFrame:
    """One row for each distinct recipe: root, digests and features of the rebuilt file, and (keep_media) the file.

    Fails if a chunk is missing or differs from its digest, if the header's length is not that of what was read, or if the
    root is not that of what was read in its order.
    """
    spark = recipes.sparkSession
    shared = spark.sparkContext.broadcast(bytes(spark.table(f"{chunk_table}_dictionary").first()["dictionary"]))
    distinct = recipes.groupBy("root").agg(F.min(F.struct("n_bytes", "header", "digests")).alias("r")).select("root", "r.*")
    parts = distinct.select("root", "header", "n_bytes", F.posexplode("digests").alias("seq", "digest"))
    parts = parts.withColumns({c: F.when(F.col("seq") == 0, F.col(c)) for c in ("header", "n_bytes")})  # once for each file
    found = parts.join(spark.table(chunk_table), "digest", "left")
    ordered = found.select("root", "header", "n_bytes", "seq", "digest", "data").repartition("root").sortWithinPartitions("root", "seq")

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        root, header, n_bytes, names, parts = None, b"", 0, [], []

        def finish():
            if _root(header, n_bytes, names) != root:
                raise ValueError(f"media store: what was read is not the file of {root.hex()}")
            payload = b"".join(parts)
            if header != wav_header(len(payload)):
                raise ValueError(f"media store: the file of {root.hex()} has a wrong length")
            media = header + payload
            return root, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(payload, dtype=np.uint8)), media if keep_media else b""

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), MEDIA.types, strict=True)], schema=MEDIA)

        for b in batches:
            out = []
            for r, h, n, d, data in zip(*(b.column(c).to_pylist() for c in ("root", "header", "n_bytes", "digest", "data")), strict=True):
                if r != root:
                    if root is not None:
                        out.append(finish())
                    root, header, n_bytes, names, parts = r, h, n, [], []
                if data is None:
                    raise ValueError(f"media store: no chunk {d.hex()}")
                raw = unpack.decompress(data)
                if _digest(raw) != d:
                    raise ValueError(f"media store: chunk {d.hex()} is damaged")
                names.append(d)
                parts.append(raw)
            if out:
                yield batch(out)
        if root is not None:
            yield batch([finish()])

    return ordered.mapInArrow(run, "root binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def drop_media(recipes: DataFrame, chunk_table: str) -> None:
    """Delete a store whose files nothing will read again."""
    for name in (chunk_table, f"{chunk_table}_dictionary"):
        recipes.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    forget(recipes)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"turnweave_chunks_{uuid.uuid4().hex}"
    recipes = write_media(table(spark, sf_dir, "documents"), name)
    back = read_media(recipes, name, keep_media=False)
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out = materialize(recipes.select("doc_id", "n_bytes", "root").join(back, "root").select(*columns))
    drop_media(recipes, name)
    return out
