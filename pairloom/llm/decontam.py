"""Benchmark decontamination by training suffix arrays.

Each shard (a few MB of whole texts) is a word array with one suffix array; every
suffix of the benchmark items is binary-searched in it. Before sorting, positions
whose run of benchmark vocabulary is shorter than the shortest window are left out:
no window can begin there, so the array keeps every suffix that can match. A match of
an item lies within a run of hit words, so the longest verbatim match of an item, with
its places in the text and in the item, is read off the item's suffix automaton there.

Only the benchmark is broadcast, in blocks of at most ``block_words`` words; each
block is one more pass over the texts, and the passes are merged by row.

Defined results: a null or wordless text has no hits and is not contaminated;
wordless and null items match nothing; a null item_id is listed as the empty string;
repeated items are listed once; of equally long matches the first in the text, then in
the item, is told; of an item longer than a block, the longest within one block; repeated documents are each reported; an empty
table on either side gives no rows or no hits; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.words import ALNUM_LOWER, runs, slices, words
from pairloom.plans.scratch import Scratch

SPANS = "array<struct<first:long,last:long>>"
MATCHES = "array<struct<item_id:string,length:long,text_first:long,item_first:long>>"
REPORT = f"n_words long, n_hit long, longest long, spans {SPANS}, item_ids array<string>, matches {MATCHES}"
_MATCH = pa.struct([("item_id", pa.string()), ("length", pa.int64()), ("text_first", pa.int64()), ("item_first", pa.int64())])
_ARROW = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("longest", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("item_ids", pa.list_(pa.string())),
    ("matches", pa.list_(_MATCH)),
]


class Automaton:
    """Suffix automaton of an item's words: ``longest`` finds the longest run that a text shares with it."""

    def __init__(self, words: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(words):
            new = self._state({}, self.length[last] + 1, at)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(word) == q:
                        self.next[p][word] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            else:
                self.link[new] = 0
            last = new

    def _state(self, to: dict[int, int], length: int, end: int) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)  # where the state's runs end first
        return len(self.next) - 1

    def longest(self, words: list[int]) -> tuple[int, int, int]:
        """Length of the longest shared run, and where it begins in ``words`` and in the item."""
        state = size = 0
        best = (0, 0, 0)
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size > best[0]:
                best = (size, at - size + 1, self.end[state] - size + 1)
        return best


class TestSuffixes:
    """The windows of the items as suffixes over their own vocabulary, each distinct one once."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str, int]], window: int):
        w = words(pa.array([t for _, t, _ in items], pa.string()), ALNUM_LOWER)
        self.vocabulary = np.unique(w.hash)
        ids = (np.searchsorted(self.vocabulary, w.hash) + 1).astype(">u4")
        found: dict[tuple[int, bytes], set[int]] = {}
        self.words: list[list[int]] = []
        for k in range(len(items)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            self.words.append(ids[a:b].tolist())
            size = min(window, b - a)
            for p in range(a, b - size + 1) if size else ():
                found.setdefault((size, ids[p : p + size].tobytes()), set()).add(k)
        self.of = [(item, offset) for item, _, offset in items]
        self.automata: dict[int, Automaton] = {}
        self.depth = max([size for size, _ in found], default=0)
        self.least = min([size for size, _ in found], default=0)
        self.sizes = np.array([size for size, _ in found], np.int64)
        self.keys = np.array([key.ljust(4 * self.depth, b"\0") for _, key in found] or [b""], f"S{4 * self.depth or 1}")
        self.ends = np.array([key.ljust(4 * self.depth, b"\xff") for _, key in found] or [b""], f"S{4 * self.depth or 1}")
        self.items = list(found.values())

    def longest(self, k: int, spans: list[tuple[int, list[int]]]) -> dict:
        """The longest match of item k within spans, each given by its place in the text and its words."""
        if k not in self.automata:
            if len(self.automata) >= 256:
                self.automata.clear()
            self.automata[k] = Automaton(self.words[k])
        item, offset = self.of[k]
        out = {"item_id": item, "length": 0, "text_first": 0, "item_first": 0}
        for first, words_ in spans:
            length, at, own = self.automata[k].longest(words_) if len(words_) > out["length"] else (0, 0, 0)
            if length > out["length"]:
                out |= {"length": length, "text_first": first + at, "item_first": offset + own}
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 1 for words of the vocabulary, 0 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(">u4")


def suffix_array(ids: np.ndarray, keep: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions in the order of their suffixes, cut at ``depth`` words, and those suffixes as sorted keys."""
    at = np.flatnonzero(keep)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype))).astype(">u4")  # sorts as bytes
    keys = np.ascontiguousarray(padded[at[:, None] + np.arange(depth)]).view(f"S{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _search(column: pa.Array, test: TestSuffixes) -> list[tuple]:
    w = words(column, ALNUM_LOWER)
    n_texts = len(column)
    ids = np.zeros(len(w.hash) + n_texts, ">u4")  # a zero after each text keeps matches inside it
    place = np.arange(len(w.hash)) + w.text
    none = [(int(c), 0, 0, [], [], []) for c in w.counts]
    if not len(w.hash) or not test.depth:
        return none
    ids[place] = test.ids(w.hash)
    a, b = runs(ids > 0)
    room = np.zeros(len(ids), np.int64)  # how many words of the vocabulary follow
    lengths = b - a + 1
    room[np.concatenate([np.arange(x, y + 1) for x, y in zip(a[lengths >= test.least], b[lengths >= test.least])] or [np.zeros(0, np.int64)])] = 1
    inside = np.flatnonzero(room)
    if not len(inside):
        return none
    last_of = np.repeat(b[lengths >= test.least], lengths[lengths >= test.least])
    keep = np.zeros(len(ids), bool)
    keep[inside[last_of - inside + 1 >= test.least]] = True
    at, keys = suffix_array(ids, keep, test.depth)
    low, high = np.searchsorted(keys, test.keys, "left"), np.searchsorted(keys, test.ends, "right")
    cover = np.zeros(len(ids) + 1, np.int64)
    hits: dict[int, set[int]] = {}
    text_of = np.searchsorted(w.first[1:] + np.arange(1, n_texts + 1), np.arange(len(ids)), "right")
    for k in np.flatnonzero(high > low):
        where = at[low[k] : high[k]]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + test.sizes[k], -1)
        for t in np.unique(text_of[where]):
            hits.setdefault(int(t), set()).add(int(k))
    hit = np.cumsum(cover[:-1]) > 0
    out = none
    base = w.first[:-1] + np.arange(n_texts)
    for t, found in hits.items():
        inside = slice(base[t], base[t] + w.counts[t])
        own, own_ids = hit[inside], ids[inside]
        s, e = (x.tolist() for x in runs(own))
        spans = [(x, own_ids[x : y + 1].tolist()) for x, y in zip(s, e)]
        best: dict[str, dict] = {}
        for k in sorted(set().union(*(test.items[k] for k in found))):
            m = test.longest(k, spans)
            if m["item_id"] not in best or _better(m, best[m["item_id"]]):
                best[m["item_id"]] = m
        matches = [best[i] for i in sorted(best)]
        out[t] = (int(w.counts[t]), int(own.sum()), max(m["length"] for m in matches), [{"first": x, "last": y} for x, y in zip(s, e)], sorted(best), matches)
    return out


def _better(m: dict, than: dict) -> bool:
    return (-m["length"], m["text_first"], m["item_first"]) < (-than["length"], than["text_first"], than["item_first"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, str, int]]]:
    """Items, with the place of their first word, in blocks whose texts have at most ``block_words`` words; a longer item comes in overlapping pieces."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    for row in rows.toLocalIterator():
        w = row["t"].encode().translate(ALNUM_LOWER.tobytes()).split()
        step = max(block_words - window + 1, 1)
        for p in range(0, max(len(w) - window + 1, 1), step):
            piece = b" ".join(w[p : p + max(block_words, window)]).decode()
            n = min(len(w) - p, max(block_words, window))
            if block and size + n > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"], piece, p))
            size += n
    if block:
        yield block


def _pass(docs: DataFrame, text_col: str, items: list[tuple[str, str, int]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(shared.value, window)
        for part in slices(batches, at):
            found = _search(part.column(at), test)
            more = [pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *[n for n, _ in _ARROW]])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, f"{plain}, {REPORT}")


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, longest, spans, item_ids and matches of each row.

    ``spans`` are the runs of hit words; ``matches`` has, for each item that occurs, its
    longest verbatim match and where it begins in the text and in the item; ``longest`` is
    the length of the longest of these.

    Names of the report replace equal names of ``docs``. With one block of items, which
    a benchmark of up to ``block_words`` words is, the plan has no shuffle; else the result
    reads tables of the scratch, which the caller drops.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_words, window)
    report = [n for n, _ in _ARROW]
    docs = docs.drop(*[c for c in report if c in docs.columns and c != text_col])
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _pass(docs, text_col, first, window)
    scratch = scratch or Scratch(docs.sparkSession, "benchmark")
    keyed = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    slim = keyed.select("__row", F.col(text_col).alias("text"))
    parts = [_pass(slim, "text", b, window).drop("text") for b in _chain(first, second, blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    spans = out.select("__row", F.explode("spans").alias("s")).select("__row", "s.*")
    w = Window.partitionBy("__row").orderBy("first", "last")
    spans = spans.withColumn("reach", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("n", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    spans = spans.groupBy("__row", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.groupBy("__row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    order = F.struct(-F.col("m.length"), F.col("m.text_first"), F.col("m.item_first"))
    best = out.select("__row", F.explode("matches").alias("m")).groupBy("__row", "m.item_id").agg(F.min_by("m", order).alias("m"))
    best = best.groupBy("__row").agg(F.max("m.length").alias("longest"), F.sort_array(F.collect_list("m")).alias("matches"))
    best = best.withColumn("item_ids", F.transform("matches", lambda m: m["item_id"]))
    counts = out.groupBy("__row").agg(F.max("n_words").alias("n_words"))
    found = counts.join(spans, "__row", "left").join(best, "__row", "left")
    none = {"n_hit": F.lit(0), "longest": F.lit(0), "spans": F.array().cast(SPANS), "item_ids": F.array().cast("array<string>"), "matches": F.array().cast(MATCHES)}
    found = found.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return keyed.join(found, "__row").select(*docs.columns, *report)


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def contaminated() -> Column:
    """At least a twentieth of the words are in verbatim windows of items."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns that they came with."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    out = scan_benchmark(plain, benchmark, text_col=f"c{names.index(text_col)}", **options)
    return out.where(~contaminated()).select(*plain.columns).toDF(*names)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = scan_benchmark(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
