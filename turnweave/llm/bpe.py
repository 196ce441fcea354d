"""Operator 3: exact byte-level BPE by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the table holds the one token that ends the prefix's encoding.  It is the
longest vocabulary entry that ends there and is compatible with the last token of the prefix before it:
compatible means that merging the two tokens side by side would give back the same two tokens.  All
entries that end at a place come from one automaton over the vocabulary (of Aho and Corasick, whose states are the
longest suffixes of the text read that begin an entry).  Back-pointers then
give the ids.

Defined results: a null text counts as empty; an empty text has no ids, and its digests are those of the
empty string.  Repeated rows give repeated results, ties cannot occur (the encoding is unique).  An empty
table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import string

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table

#: The byte-level pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits assigned in Unicode versions after that of the tokenizers library (first-last, hex).
NEWER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Symbols that may end a word; a run of them behind letters is a pre-token of its own.
SYMBOLS = string.punctuation
#: Bytes of texts that are encoded at a time.
PORTION_BYTES = 16 << 20
#: Words remembered by one worker.
ROOM = 500_000


def newer_class() -> str:
    spans = [x.split("-") for x in NEWER.split()]
    return "[" + "".join(f"\\U{int(x[0], 16):08x}-\\U{int(x[-1], 16):08x}" for x in spans) + "]"


class PreTokenizer:
    """Splits a text as the library does; characters newer than its tables count as symbols, as they do there."""

    def __init__(self):
        new = newer_class()
        self.newer = regex.compile(new)
        self.plain = regex.compile(PATTERN)
        letters, digits = rf"[\p{{L}}--{new}]", rf"[\p{{N}}--{new}]"
        self.exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?(?:[^\s\p{{L}}\p{{N}}]|{new})+|\s+(?!\S)|\s+", regex.V1)

    def findall(self, text: str) -> list[str]:
        if not text.isascii() and self.newer.search(text):
            return self.exact.findall(text)
        return self.plain.findall(text)


class SpacedEncoder:
    """Encodes texts, cut at their spaces, by encoding each distinct word once while a worker remembers it.

    A space before a character that is no white space always begins a pre-token, so each part of a text between spaces,
    with the space before it, splits into pre-tokens as it does in place.  Most parts are letters and then symbols: two
    pre-tokens.  Texts with any other space, or with special tokens, are encoded whole.  Words of letters are remembered;
    beyond `room` of them only those of the present texts stay.
    """

    def __init__(self, special: list[str], room: int = ROOM):
        self.special_texts, self.room = special, room
        self.pattern = PreTokenizer()
        #: Ids (little-endian, unsigned, 32 bits) of words of letters behind a space, and of other pre-tokens.
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        raise NotImplementedError

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it."""
        return self.ids_of([" " + w for w in words])

    def ids_of_whole(self, text: str) -> bytes:
        """Ids of a text that cannot be cut at its spaces."""
        raise NotImplementedError

    def ids_of_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, by their pre-tokens."""
        cut = list(map(self.pattern.findall, texts))
        self._add(set().union(*cut))
        get = self.others.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _add(self, words: set[str]) -> None:
        if len(self.others) > self.room // 4:
            self.others = {}
        new = list(words - self.others.keys())
        self.others.update(zip(new, self.ids_of(new), strict=True))

    def _words(self, words: list[str], characters: str) -> tuple[list[bytes], np.ndarray]:
        """Ids of those of the words that are all letters (known to the library), and which these are."""
        newer = self.pattern.newer.search
        odd = newer(characters) is not None
        letters = [w.isalpha() and not (odd and newer(w)) for w in words]
        known = self.words
        fresh = [w for w, ok in zip(words, letters, strict=True) if ok and w not in known]
        if len(known) + len(fresh) > self.room:
            known = self.words = {w: known[w] for w in words if w in known}
        known.update(zip(fresh, self.ids_of_letters(fresh), strict=True))
        return [known[w] if ok else b"" for w, ok in zip(words, letters, strict=True)], np.array(letters, dtype=bool)

    def _parts(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts, each with a space before it."""
        stems = pc.utf8_rtrim(parts, SYMBOLS)
        tailed = pc.not_equal(pc.binary_length(stems), pc.binary_length(parts)).to_numpy(zero_copy_only=False)
        coded = stems.dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        characters = "".join(set("".join(words)))
        values, letters = self._words(words, characters)
        mixed, tailed = np.flatnonzero(~letters[at]), np.flatnonzero(tailed & letters[at])
        # what is left of a word and its symbols without the letters of all words
        tails = pc.utf8_ltrim(parts.take(pa.array(tailed)), "".join(filter(str.isalpha, characters)) or " ").dictionary_encode()
        ends = [b"", *self.ids_of_plain([*tails.dictionary.to_pylist(), *(" " + p for p in parts.take(pa.array(mixed)).to_pylist())])]
        end = np.zeros(len(parts), dtype=np.int64)
        end[tailed] = tails.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        end[mixed] = len(tails.dictionary) + np.arange(1, len(mixed) + 1)
        return pc.binary_join_element_wise(pa.array(values, pa.binary()).take(pa.array(at)), pa.array(ends, pa.binary()).take(pa.array(end)), b"")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts; a null counts as empty."""
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        coded, offsets = cut.flatten().dictionary_encode(), cut.offsets.to_numpy().astype(np.int64)
        at, first = coded.indices.to_numpy().astype(np.int64), offsets[:-1]
        # a part that is empty or begins with white space follows a space that begins no pre-token
        begin = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        spaces = [not c or c.isspace() for c in begin.dictionary.to_pylist()]
        whole = np.zeros(len(first), dtype=bool)
        if any(spaces):
            odd = np.array(spaces)[begin.indices.to_numpy()][at]
            odd[first] = False
            whole = np.add.reduceat(odd, first) > 0
        for s in self.special_texts:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        values = self._parts(coded.dictionary)
        begins: list[bytes] = self.ids_of_plain(pc.if_else(pa.array(whole), "", cut.flatten().take(pa.array(first))).to_pylist())
        for k in np.flatnonzero(whole).tolist():
            at[first[k] : offsets[k + 1]] = len(values)
            begins[k] = self.ids_of_whole(texts[k].as_py())
        at[first] = np.arange(len(first)) + len(values) + 1
        ids = pa.concat_arrays([values, pa.array([b"", *begins], pa.binary())]).take(pa.array(at))
        stops = np.frombuffer(ids.buffers()[1], dtype=np.int32, count=len(at) + 1)[offsets] // 4 if len(at) else np.zeros(1, dtype=np.int32)
        return np.diff(stops), np.frombuffer(ids.buffers()[2] or b"", dtype="<u4", count=stops[-1])

    def forget(self) -> None:
        """Called at the end of a task: the worker goes on to other stages, and words are soon learnt again."""
        self.words, self.others = {}, {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        n, ids = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable bytes stand for themselves, others move to 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizers file is byte-level with the pattern above and changes no text before."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return plain and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))


class PrefixBpe(SpacedEncoder):
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not cuts_at_spaces(spec):
            raise ValueError(f"{path}: only byte-level vocabularies with the pattern of this module are supported")
        super().__init__([t["content"] for t in spec["added_tokens"]])
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            self.made.setdefault(pair, whole)
            self.halves.setdefault(whole, (r, *pair))
        self.suffixes = ahocorasick.Automaton()
        for t, i in vocab.items():
            word = "".join(chr(alphabet[c]) for c in t)
            if len(word) == 1 or self._canonical(i):
                self.suffixes.add_word(word, (i, len(word)))
        self.suffixes.make_automaton()
        self.fits: dict[int, bool] = {}
        self.one_id = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens])
        self.names = pa.array([str(i) for i in range(len(tokens))])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain greedy merging, lowest rank first and leftmost; only used to vet vocabulary entries."""
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: (self.rank.get((ids[k], ids[k + 1]), 1 << 60), k))
            if (ids[best], ids[best + 1]) not in self.rank:
                break
            ids[best : best + 2] = [self.made[ids[best], ids[best + 1]]]
        return ids

    def _canonical(self, token: int) -> bool:
        """Whether merging the entry's own bytes ends in the entry; others can never be emitted."""
        if not hasattr(self, "_single"):
            self._single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        return self._merge([self._single[b] for b in self.bytes_of[token]]) == [token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, are still left and right after all merges.

        Takes the two tokens apart along the seam in the reverse order of their merges.  Some pair that meets
        at the seam with a merge earlier than both of its parts' next use would have crossed the seam.
        """
        bound = 1 << 60
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < bound:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            # undo the later of the two merges; a crossing pair on a tie is decided by position: leftmost first
            if b is None or (a is not None and a[0] > b[0]):
                bound, left = a[0], a[2]
            else:
                bound, right = b[0] + 1, b[1]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (token, length) in self.suffixes.iter(word.decode("latin-1")):
            e = end + 1
            if last[e] >= 0:
                continue
            s = e - length
            if s:
                before = last[s]
                if before < 0:
                    continue
                key = before << 24 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 250_000:
                        fits.clear()
                    ok = fits[key] = self._compatible(before, token)
                if not ok:
                    continue
            last[e], size[e] = token, length
        out, e = [], n
        while e:
            out.append(last[e])
            e -= size[e]
        return out[::-1]

    def ids_of(self, words: list[str]) -> list[bytes]:
        one, encode = self.one_id, self.encode_word
        return [b"".join(map(one.__getitem__, encode(w.encode()))) for w in words]

    def ids_of_whole(self, text: str) -> bytes:
        out = []
        for part in self.split.split(text) if self.split else (text,):
            out.append(self.one_id[self.special[part]] if part in self.special else self.ids_of_plain([part])[0])
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of texts, in UTF-8, from their ids: counts[k] of the ids are text k's."""
        size = self.token_sizes[ids]
        ends = np.cumsum(size)
        # place of every byte in the bytes of all tokens: a token's first place, then one more for each byte
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.token_starts[ids] - (ends - size), size)
        data = self.token_bytes[place].tobytes()
        stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        parts = [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        return [p if p.isascii() else p.decode("utf-8", "replace").encode() for p in parts]


_LOADED: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """One encoder for each worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and the text decoded from these ids, for every row of docs (doc_id, text)."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(path)
        for b in portions(batches):
            n, ids = bpe.encode_column(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids.astype(np.int32)))
            back = pa.array(bpe.decode_many(ids, n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists, back], schema=TOKENS)
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The digests of encode_documents() without moving the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(path)
        for b in portions(batches, most=PORTION_BYTES):
            n, ids = bpe.encode_column(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), bpe.names.take(pa.array(ids)))
            listed = pc.binary_join(lists, ",").to_pylist()
            shas = [[hashlib.sha256(x).hexdigest() for x in part] for part in (map(str.encode, listed), bpe.decode_many(ids, n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in shas)], schema=DIGESTS)
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
