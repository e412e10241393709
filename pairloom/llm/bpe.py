"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves hold the rank of each adjacent pair, with its place; a node holds the
least of its two, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves, each in logarithmic time, until the root holds no pair. The
vocabulary file, its normaliser and its pre-tokeniser are those of the public
tokenizer whose path is given; nothing is trained.

White space ends every piece, so a text is encoded word by word. Normaliser and
pre-tokeniser are the library's own, so that letters are those of its version of Unicode;
words of printable ASCII, where the rules are plain, are split here. The merges are
all done here. The ids of words are kept in a cache of each worker, bounded in number
and, as longer words are not kept, in bytes.

Defined results: a null text is the empty text, with no ids; repeated rows are each
encoded; texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = 1 << 100
KEPT = 64  # bytes of the longest word whose ids are kept
#: Runs of letters, single digits, runs of other marks, after the endings that stand alone.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
PRINTABLE = bytes(range(0x21, 0x7F))


class PairTree:
    """Segment tree of the least (rank, place) over adjacent pairs."""

    __slots__ = ("size", "node")

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        node = [NONE] * size + keys + [NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        self.size, self.node = size, node

    def set(self, place: int, key: int) -> None:
        node = self.node
        i = self.size + place
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a < b else b
            if node[i] == least:
                return
            node[i] = least
            i >>= 1


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Symbols after all merges; ``pairs``: left << 32 | right to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = pairs.get
    found = [get(symbols[i] << 32 | symbols[i + 1]) for i in range(n - 1)]
    if not any(found):
        return symbols
    place = n.bit_length()  # bits of a pair's place within a key
    tree = PairTree([f[0] << place | i if f else NONE for i, f in enumerate(found)])
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    node, mask = tree.node, (1 << place) - 1
    while node[1] != NONE:
        i = node[1] & mask
        j = after[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        symbols[j] = -1
        k = after[j]
        after[i] = k
        if j < n - 1:
            tree.set(j, NONE)
        if k < n:
            before[k] = i
            f = get(symbols[i] << 32 | symbols[k])
            tree.set(i, f[0] << place | i if f else NONE)
        else:
            tree.set(i, NONE)
        h = before[i]
        if h >= 0:
            f = get(symbols[h] << 32 | symbols[i])
            tree.set(h, f[0] << place | h if f else NONE)
    return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class _Words(dict):
    """Ids of words, as the bytes of unsigned 32-bit integers; emptied when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self.make(word)
        if len(word) <= KEPT:
            self[word] = out
        return out


class SegmentTreeBPE:
    """Encoder and decoder for a tokenizer file with NFC, white space, lower case; split by its pattern; word ends."""

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or byte_level["type"] != "ByteLevel" or byte_level["add_prefix_space"] or not split["invert"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: another normaliser, pre-tokeniser or decoder than this encoder has")
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.first = {c: vocab[c] for c in byte_letters()}
        self.last = {c: vocab[c + end] for c in byte_letters()}
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [self.by_id.get(i, "").encode() for i in range(max(self.by_id) + 1)]
        library = Tokenizer.from_file(path)
        self.normalize, self.pieces_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.piece = _Words(self._piece, cache)
        self.word = _Words(self._word, cache)

    def _piece(self, piece: str) -> bytes:
        """``piece``: its bytes as letters."""
        first = self.first
        symbols = [first[c] for c in piece]
        symbols[-1] = self.last[piece[-1]]
        return array("I", merge(symbols, self.pairs)).tobytes()

    def _word(self, word: bytes) -> bytes:
        piece = self.piece
        if not word.translate(None, PRINTABLE):
            return b"".join([piece[p.decode()] for p in ASCII_PIECES(word.lower())])
        return b"".join([piece[p] for p, _ in self.pieces_of(self.normalize(word.decode()))])

    def _plain(self, text: str) -> bytes:
        word = self.word
        return b"".join([word[w] for w in text.encode().split()])

    def encode(self, text: str | None) -> bytes:
        """Ids as the bytes of little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        out = [array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.specials.split(text)]
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the tokens with one space between; unknown ids are left out."""
        token, top = self.token, len(self.token)
        try:
            out = [token[i] for i in ids]
        except IndexError:
            out = [token[i] for i in ids if i < top]
        return b" ".join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def _mapped(docs: DataFrame, text_col: str, more: list[tuple[str, str, pa.DataType]], row, keep_text: bool) -> DataFrame:
    """``docs`` with what ``row(text)`` gives; names of ``more`` replace equal names of ``docs``."""
    names = {n for n, _, _ in more}
    docs = docs.select(*[c for c in docs.columns if c not in names or c == text_col])
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if (keep_text or i != at) and c not in names]
    fields = [docs.schema[i] for i in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got = [row(t.as_py()) for t in part.column(at)]
                cols = [_column([g[k] for g in got], t) for k, (_, _, t) in enumerate(more)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *cols], names=[*[f.name for f in fields], *[n for n, _, _ in more]])

    plain = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"{n} {t}" for n, t, _ in more]])
    return docs.mapInArrow(run, plain)


def encode_column(docs: DataFrame, text_col: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens``; no shuffle."""
    path = path or default_path()

    def row(text):
        ids = np.frombuffer(tokenizer(path).encode(text), "<u4").astype(np.int32)
        return ids, len(ids)

    return _mapped(docs, text_col, [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64())], row, keep_text)


def decode_column(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``; a null id list decodes to the empty string."""
    path = path or default_path()
    names = [c for c in docs.columns if c != "decoded"]
    docs = docs.select(*names)
    at = names.index(ids_col)

    def run(batches):
        for batch in batches:
            text = [tokenizer(path).decode(x or []).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*names, "decoded"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{plain}, decoded string")


def encode_and_decode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens and the digests of the ids and of what they decode to, in one pass over the texts."""
    path = path or default_path()

    def row(text):
        t = tokenizer(path)
        ids = t.encode(text)
        decoded = t.decode(np.frombuffer(ids, "<u4").tolist())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _mapped(docs, text_col, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], row, keep_text)


def encode_whole(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without the text, with ids, n_tokens and the digest of what the ids decode to."""
    path = path or default_path()

    def row(text):
        t = tokenizer(path)
        ids = np.frombuffer(t.encode(text), "<u4")
        return ids.astype(np.int32), len(ids), hashlib.sha256(t.decode(ids.tolist())).hexdigest()

    return _mapped(docs, text_col, [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64()), ("decoded_sha256", "string", pa.string())], row, keep_text=False)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_and_decode(docs.select("doc_id", "text"))
