"""Token-id files with a minimal perfect hash index for keyed access.

A shard is one file: a header, the raw ids of its documents one after another, then
the index and a footer that says where each part begins. The index is a minimal
perfect hash over the shard's distinct keys (levels of bit arrays; a key stays on the
first level where it is alone, and the rank of its bit is its number), and for each
number a 32-bit fingerprint, the first document and how many have the key. A lookup
hashes the key a few times, reads one entry and one slice of ids, whatever the shard's
size. Shards hold ranges of keys in ascending order; the manifest has one row a shard.

Ids are written with 2 bytes where the vocabulary allows it, else with 4.

Files are written under a name of the attempt and then renamed, and their content
depends on the input alone: a task that runs again writes the same file.

Defined results: a null text is empty and has only the end id; null keys come first,
and are in no index; rows with one key lie together, ordered by their text; an empty
table gives an empty manifest and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import KEPT, default_path
from pairloom.llm.words import mix, slices
from pairloom.plans.scratch import Scratch

MAGIC = b"PLTOKEN1"
FOOTER = struct.Struct("<8Q8s")  # width, documents, nulls, keys, and where keys, offsets, index and levels begin
NO_KEY = -(1 << 63)


TAIL = b".,!?;:#$%&*|()"


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each word that is not in a cache.

    White space ends every piece of this tokenizer, its special tokens hold none, and a
    run of marks after a letter or digit is a piece of its own: so a text is cut into
    words, and a word into what comes before such a run and the run. Whether a character
    is a letter or digit to its end (some become a letter and a mark) is asked of the
    library's own normaliser and pre-tokeniser, once for each character. New parts go to
    the library many at a time: those of letters alone, each one piece, with a space
    between them, as the last token of a piece is known by its form; the others with a
    special token. Parts of over KEPT bytes are not kept.
    """

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        kinds = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        kinds += [x["type"] for x in spec["normalizer"]["normalizers"]]
        special = [x for x in spec["added_tokens"] if x["special"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"])]
        if kinds != ["Split", "ByteLevel", "NFC", "Replace", "Lowercase"] or not special:
            raise ValueError(f"{path}: words of this tokenizer can't be encoded apart")
        self.between, self.between_id = special[0]["content"], special[0]["id"]
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        self.sign = os.path.commonprefix(self.specials)  # a word without it has no special token, in either case of letters
        if not self.sign or self.sign.lower() != self.sign.upper():
            raise ValueError(f"{path}: special tokens have no common beginning to know them by")
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.most = cache
        self.word: dict[bytes, bytes] = {}
        self.word_before: dict[bytes, bytes] = {}
        self.part: dict[bytes, bytes] = {}
        self.part_before: dict[bytes, bytes] = {}
        self.ends: dict[str, bool] = {}
        self.letters: dict[str, bool] = {}
        last = spec["model"]["end_of_word_suffix"]
        self.is_last = np.zeros(self.vocabulary, bool)
        self.is_last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(last)]] = True

    def _of_letters(self, part: str) -> bool:
        """Whether a part has only letters, to the library and after its normaliser too."""
        for c in part if not part.isascii() else "" if part.isalpha() else "-":
            if c not in self.letters:
                normal = self.library.normalizer.normalize_str(c)
                pieces = self.library.pre_tokenizer.pre_tokenize_str(f"a{normal}a")
                self.letters[c] = len(normal) == 1 and len(pieces) == 1
            if not self.letters[c]:
                return False
        return True

    def _ends_before_marks(self, last: str) -> bool:
        """Whether marks after this character are a piece of their own."""
        if last not in self.ends:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(last) + TAIL.decode())
            self.ends[last] = len(pieces) > 1 and pieces[-1][0] == TAIL.decode()
        return self.ends[last]

    def _parts(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """What the library is asked for: the two parts of each word, in lower case if it is ASCII (else NFC comes before that)."""
        sign, ends = self.sign, self._ends_before_marks
        words = [w.lower() if w.isascii() and sign not in w else w for w in words]
        cores = [w.rstrip(TAIL) for w in words]
        return [
            (w, b"") if len(c) == len(w) or not c or sign in w or not (c[-1:].isalnum() if c[-1] < 128 else ends(c.decode()[-1])) else (c, w[len(c) :])
            for w, c in zip(words, cores)
        ]

    def _ask(self, parts: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        plain, other = [], []
        for p in parts:
            text = p.decode()
            if self.sign in p:
                out[p] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                (plain if self._of_letters(text) else other).append(text)
        for between, texts in ((" ", plain), (self.between, other)):
            runs_ = [texts[k : k + 200] for k in range(0, len(texts), 200)]
            for run, got in zip(runs_, self.library.encode_batch_fast([between.join(r) for r in runs_], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                raw = ids.tobytes()
                if between == " ":
                    end = (4 * np.flatnonzero(self.is_last[ids]) + 4).tolist()
                    start = [0, *end[:-1]]
                else:
                    end = [*(4 * np.flatnonzero(ids == self.between_id)).tolist(), len(raw)]
                    start = [0, *[e + 4 for e in end[:-1]]]
                if len(end) != len(run) or end[-1] != len(raw):
                    raise ValueError("the library has joined parts that were apart")
                out.update(zip([t.encode() for t in run], [raw[a:b] for a, b in zip(start, end)]))
        return [out[p] for p in parts]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        split = [(t or "").encode().split() for t in texts]
        self.word, self.word_before, new = _known(self.word, self.word_before, set().union(*split), self.most)
        cut = self._parts(new)
        self.part, self.part_before, ask = _known(self.part, self.part_before, {p for two in cut for p in two if p}, self.most)
        word, part = self.word, self.part
        part.update(zip(ask, self._ask(ask)))
        part[b""] = b""
        word.update(zip(new, [part[a] + part[b] for a, b in cut]))
        out = [b"".join([word[w] for w in s]) for s in split]
        for cache, keys in ((word, new), (part, ask)):
            for long in [k for k in keys if len(k) > KEPT]:
                del cache[long]
        return out


def _known(now: dict, before: dict, wanted: set, most: int) -> tuple[dict, dict, list]:
    """A cache in two halves, and what is in neither: a full half becomes the old one, from which what is wanted comes back."""
    if len(now) > most // 2:
        now, before = {}, now
    missing = wanted.difference(now)
    now.update({w: before[w] for w in missing if w in before})
    return now, before, [w for w in missing if w not in before]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash over distinct long keys: levels of bits, with ranks by 64-bit word."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # each an array of 64-bit words
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        before = np.cumsum([0, *[int(c.sum()) for c in counts]])
        self.ranks = [np.concatenate(([0], np.cumsum(c)[:-1])) + b for c, b in zip(counts, before)]

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        left, levels = keys, []
        while len(left):
            bits = max(64, int(len(left) * spread) + 63 & ~63)
            at = (_hash(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            n = np.bincount(at, minlength=bits)
            alone = n == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = left[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1, or the number of another, for keys that were not given."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, words in enumerate(self.levels):
            bit = _hash(keys[left], k) % np.uint64(64 * len(words))
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            hit = (words[word] >> shift & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[left[hit]] = (self.ranks[k][word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + x.astype("<u8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            levels.append(np.frombuffer(raw, "<u8", size, at + 8).astype(np.uint64))
            at += 8 + 8 * size
        return cls(levels)


INDEX = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("first", "<u8")])


class ShardWriter:
    """Writes one shard: ids as they come, the index at the end; only keys and offsets are held."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, width: int):
        self.fs, self.path, self.width = fs, path, width
        self.temp = f"{path}.{uuid.uuid4().hex}.part"
        self.out = fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.keys: list[int] = []
        self.counts: list[int] = []
        self.nulls = 0

    def add(self, key: int | None, ids: bytes) -> None:
        if key is None:
            self.nulls += 1
        self.keys.append(NO_KEY if key is None else key)
        self.counts.append(len(ids) // 4)
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        keys, offsets = np.array(self.keys, "<i8"), np.concatenate(([0], np.cumsum(np.array(self.counts, np.int64)))).astype("<u8")
        own, first, count = np.unique(keys[self.nulls :], return_index=True, return_counts=True)
        table = PerfectHash.build(own)
        index = np.zeros(len(own), INDEX)
        number = table.number(own)
        index["fingerprint"][number], index["count"][number], index["first"][number] = _fingerprint(own), count, first + self.nulls
        places = []
        for part in (keys.tobytes(), offsets.tobytes(), index.tobytes(), table.to_bytes()):
            places.append(self.out.tell())
            self.out.write(part)
        self.out.write(FOOTER.pack(self.width, len(keys), self.nulls, len(own), *places, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(keys), int(offsets[-1])


@dataclass
class Shard:
    """An opened shard; ``ids`` reads a slice of the file for each call."""

    file: pa.NativeFile
    width: int
    keys_at: int
    offsets_at: int
    n: int
    nulls: int
    index: np.ndarray
    table: PerfectHash

    @classmethod
    def open(cls, path: str) -> Shard:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        f = fs.open_input_file(at)
        size = f.size()
        width, n, nulls, keys, keys_at, offsets_at, index_at, levels_at, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        index = np.frombuffer(f.read_at(keys * INDEX.itemsize, index_at), INDEX)
        return cls(f, width, keys_at, offsets_at, n, nulls, index, PerfectHash.from_bytes(f.read_at(size - FOOTER.size - levels_at, levels_at)))

    def ids(self, first: int, last: int) -> np.ndarray:
        raw = self.file.read_at((last - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def bounds(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a + 1) * 8, self.offsets_at + a * 8), "<u8").astype(np.int64)

    def keys(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * 8, self.keys_at + a * 8), "<i8")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with the key, none if it has none."""
        one = np.array([key], "<i8")
        k = int(self.table.number(one)[0])
        if k < 0 or self.index["fingerprint"][k] != _fingerprint(one)[0]:
            return []
        first, count = int(self.index["first"][k]), int(self.index["count"][k])
        if int(self.keys(first, first + 1)[0]) != key:
            return []
        b = self.bounds(first, first + count)
        return [self.ids(int(x), int(y)) for x, y in zip(b[:-1], b[1:])]


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1, shards: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards in ascending key order; gives the manifest: shard, path, low, high, n_docs, n_ids, start.

    ``shards``: how many, 0 for the session's number of shuffle partitions. A task holds
    no more of its shard than keys, offsets and one batch.
    """
    spark = docs.sparkSession
    own = scratch or Scratch(spark, "manifest")
    vocabulary_path = path or default_path()
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else struct.pack("<I", end_id)
    slim = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.octet_length("text")]
    dealt = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, writer, low, high = library_encoder(vocabulary_path), None, None, None
        for batch in batches:
            for part in slices(iter([batch]), 1):
                keys = part.column(0).to_pylist()
                if writer is None:
                    fs, inside = pyarrow.fs.FileSystem.from_uri(folder)
                    fs.create_dir(inside, recursive=True)
                    width = 2 if max(encoder.vocabulary, end_id or 0) <= 1 << 16 else 4
                    writer, low = ShardWriter(fs, f"{inside}/shard-{shard:06d}.ids", width), keys[0]
                high = keys[-1]
                for key, ids in zip(keys, encoder.encode_all(part.column(1).to_pylist())):
                    writer.add(key, ids + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            cols = [pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{folder}/shard-{shard:06d}.ids", pa.string()), (low, pa.int64()), (high, pa.int64()), (n_docs, pa.int64()), (n_ids, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "path", "low", "high", "n_docs", "n_ids"])

    manifest = own.write(dealt.mapInArrow(write, "shard int, path string, low long, high long, n_docs long, n_ids long"), "manifest")
    start, rows = 0, []
    for r in manifest.orderBy("shard").collect():  # one row a shard
        rows.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "shard int, path string, low long, high long, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard.open(r["path"])
                for a in range(0, s.n, 2000):
                    b = min(a + 2000, s.n)
                    at = s.bounds(a, b)
                    ids = s.ids(int(at[0]), int(at[-1]))
                    each = [ids[x:y] for x, y in zip(at[:-1] - at[0], at[1:] - at[0])]
                    key = pa.array(s.keys(a, b), mask=np.arange(a, b) < s.nulls)
                    cols = [key, pa.array(at[:-1] + r["start"]), pa.array(np.diff(at)), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def lookup(manifest: list[tuple[str, int | None, int | None]], key: int) -> list[np.ndarray]:
    """Ids of the documents with a key, by (path, low, high) of the shards: those whose range holds it are asked."""
    out = []
    for path, low, high in manifest:
        if high is not None and (low is None or low <= key) and key <= high:
            out += Shard.open(path).get(key)
    return out


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.path}/files", scratch=scratch)
    return scratch.finish(read_token_files(manifest, with_ids=False))
