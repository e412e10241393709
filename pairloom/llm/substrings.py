"""Substring dedup by prefix-partitioned suffix trees, at word level.

Exact copies of a text are one class: the row with its smallest id is searched, the
others are repeats as a whole if they have a window. This comes before all else, so a
large group of copies costs its number of ids.

Every window of ``window`` words has one anchor: the leftmost of its prefixes-to-be
(runs of ``prefix`` words) with the least hash. Equal windows have their anchors at
the same place, so only suffixes that begin at anchors are needed. They are dealt by
their first ``prefix`` words, and an anchor that is alone is dropped there.

The suffixes that stay come with the words before and after them, and are dealt by
the same prefix. A task takes whole prefix groups of up to ``group_rows`` suffixes,
sorts them and reads the suffix tree's internal nodes off the common prefix lengths,
to the right and, reversed, to the left: two windows are equal if they lie below the
same right node and the same left node at depths that add up to the window. Of each
such class all but the earliest are repeats.

Prefixes are of variable length. One that over one in ``HOT_SHARE`` of all anchors has
(fewer than twice that many are, so they are broadcast), or that gives a group of over
``group_rows`` suffixes, is lengthened to the whole window: the suffixes are then those
at the windows' own starts, and a group is one node. What repeats within one part of
the input is told there, and only the first of each window in a part goes on.

Hashes only bring candidates together. The words themselves go with each suffix, and
windows are equal if their words are; of a word of over LONG bytes, its SHA-256.

Defined results: a null text has no words; a text shorter than a window loses nothing;
rows with one id are one document, so equal starts in them are not earlier; ids are
whole numbers (others raise); a null id counts as the largest; repeated rows get equal
results; an empty table gives no rows; other columns pass through, unless they have the
name of a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import WHITE, Words, mix, runs, slices, words
from pairloom.plans.hot import join_with_hot_keys
from pairloom.plans.scratch import Scratch

HOT_SHARE = 4096
LONG = 64


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words at each place; shorter by size - 1."""
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(size if n > 0 else 0):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width``."""
    n = len(x) - width + 1
    best, at = x.copy(), np.arange(len(x))
    span = 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        right = best[step:] < best[:m]
        best = np.where(right, best[step:], best[:m])
        at = np.where(right, at[step:], at[:m])
        span += step
    return at[:n]


def anchors(w: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: text, place within all words, first and last window start that it stands for, prefix hash."""
    empty = np.zeros(0, np.int64)
    if len(w.hash) < window:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    grams = _gram_hashes(w.hash, prefix)
    at = _least(grams, window - prefix + 1)
    text = w.text
    inside = np.flatnonzero(text[: len(at)] == text[window - 1 : window - 1 + len(at)])
    at = at[inside]
    if not len(at):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)))
    first = inside[new]
    last = np.concatenate((inside[np.flatnonzero(new)[1:] - 1], inside[-1:]))
    place = at[new]
    return text[place], place, first, last, grams[place]


class _Numbers(dict):
    """A number from 1 for each word that is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


def _numbered(ctx: list[bytes], before: np.ndarray, after: np.ndarray, left: int, window: int) -> np.ndarray:
    """Words around suffixes as numbers, ``left`` before and ``window`` from each; 0 is no word."""
    number = _Numbers()
    out = np.zeros((len(ctx), left + window), ">u4")
    at = np.arange(left + window)[None]
    inside = (at >= left - before[:, None]) & (at < left + after[:, None])
    out[inside] = np.fromiter(map(number.__getitem__, b" ".join(ctx).split(b" ")), np.int64, int(inside.sum()))
    return out


def _window_flags(rows: dict[str, np.ndarray], ids: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """(row, start) of windows that repeat an earlier one, for whole prefix groups; ``ids``: the words around each suffix."""
    n, left = len(rows["pos"]), window - prefix
    right_keys = np.ascontiguousarray(ids[:, left:])
    left_keys = np.ascontiguousarray(ids[:, :left][:, ::-1])

    def nodes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the sorted keys, and how many words each shares with the one before."""
        width = keys.shape[1]
        order = np.argsort(keys.view(f"S{4 * width}").ravel(), kind="stable")
        by_word = keys[order]
        same = by_word[1:] == by_word[:-1]
        shared = np.concatenate(([0], np.where(same.all(axis=1), width, np.argmin(same, axis=1))))
        return order, shared

    r_order, r_shared = nodes(right_keys)
    l_order, l_shared = nodes(left_keys)
    doc, pos = rows["doc"], rows["pos"]
    out = []
    for o in range(left + 1):
        start = pos - o
        ok = np.flatnonzero((start >= rows["lo"]) & (start <= rows["hi"]))
        if len(ok) < 2:
            continue
        r_node, l_node = np.empty(n, np.int64), np.empty(n, np.int64)
        r_node[r_order] = np.cumsum(r_shared < window - o)
        l_node[l_order] = np.cumsum(l_shared < o) if o else 0
        kind = r_node[ok] * (n + 1) + l_node[ok]
        order = np.lexsort((start[ok], doc[ok], kind))
        k, d, s = kind[order], doc[ok][order], start[ok][order]
        fresh = np.concatenate(([True], k[1:] != k[:-1]))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
        later = (d != d[head]) | (s != s[head])
        out.append(np.column_stack((ok[order][later], s[later])))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


_RUNS = [("doc", pa.int64()), ("t1", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]
_TOLD = "doc long, t1 long, a int, b int, win binary"


def _told(doc: np.ndarray, t1: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Starts of repeated windows as runs, one row a run."""
    order = np.lexsort((start, t1, doc))
    doc, t1, start = doc[order], t1[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (t1[1:] != t1[:-1]) | (start[1:] > start[:-1] + 1)))[: len(doc)]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1])) if len(first) else first
    cols = [doc[first], t1[first], start[first].astype(np.int32), start[last].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, (_, t) in zip(cols, _RUNS)], pa.nulls(len(first), pa.binary())], names=["doc", "t1", "a", "b", "win"])


def _asked(doc: np.ndarray, t1: np.ndarray, start: np.ndarray, win: list[bytes]) -> pa.RecordBatch:
    """Windows that must be compared with those of other parts."""
    at = pa.array(start.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(t1, pa.int64()), at, at, pa.array(win, pa.binary())], names=["doc", "t1", "a", "b", "win"])


def _ints(part: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {n: part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names}


class _Spelled:
    """The words of a slice of texts, one space between, those of over LONG bytes by their digest."""

    def __init__(self, column: pa.Array):
        every = [w for t in column.to_pylist() for w in (t or "").encode().split()]
        self.lengths = np.fromiter(map(len, every), np.int64, len(every))
        for k in np.flatnonzero(self.lengths > LONG).tolist():
            every[k] = b"\t" + hashlib.sha256(every[k]).digest().hex().encode()
            self.lengths[k] = len(every[k])
        self.data = b" ".join(every)
        self.at = np.concatenate(([0], np.cumsum(self.lengths + 1)))

    def runs(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words from ``first`` to before ``last``, which is beyond it."""
        data = self.data
        return [data[a:b] for a, b in zip(self.at[first].tolist(), (self.at[last] - 1).tolist())]


def _hot_prefixes(texts: DataFrame, window: int, prefix: int, own: Scratch) -> np.ndarray:
    """All prefixes that over one in HOT_SHARE of the anchors have (256 at least), and some that half of that have.

    A slice tells those that over half that share of its own anchors have. What it does
    not tell of a prefix is at most half the share, so the sum of what is told finds all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            *_, h = anchors(words(part.column(2), WHITE), window, prefix)
            each, n = np.unique(h, return_counts=True)
            often = 2 * HOT_SHARE * n > len(h)
            cols = [pa.array(np.append(each[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(h)))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "total"])

    told = own.write(texts.mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "often")
    most = max((told.agg(F.sum("total")).first()[0] or 0) / HOT_SHARE, 256)
    hot = np.array([r[0] for r in told.where(2 * F.col("n") > most).select("h").collect()], np.int64)
    own.drop(told)
    return np.sort(hot.view(np.uint64))


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def _windows_in_part(part: pa.RecordBatch, hot: np.ndarray, window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Of windows below hot prefixes: those that repeat an earlier one of this part, and the first of each, with its words."""
    w = words(part.column(2), WHITE)
    _, _, lo, hi, h = anchors(w, window, prefix)
    below = _among(h, hot)
    lo, n = lo[below], (hi - lo + 1)[below]
    if not len(lo):
        return
    start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = w.text[start]
    doc, t1 = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[text] for k in (0, 1))
    at = start - w.first[text]
    kind = _gram_hashes(w.hash, window)[start]
    order = np.lexsort((at, doc, kind))
    fresh = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    spelled = _Spelled(part.column(2))
    later = (doc != doc[head]) | (at != at[head])
    told = np.zeros(len(start), bool)
    for k in range(0, len(start), 50_000):
        some = k + np.flatnonzero(later[k : k + 50_000])
        mine = spelled.runs(start[some], start[some] + window)
        told[some] = [x == y for x, y in zip(mine, spelled.runs(start[head[some]], start[head[some]] + window))]
    yield _told(doc[told], t1[told], at[told])
    ask = np.flatnonzero(~told)
    for k in range(0, len(ask), 20_000):
        e = ask[k : k + 20_000]
        yield _asked(doc[e], t1[e], at[e], spelled.runs(start[e], start[e] + window))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by their words, then place: all but the first place of each."""
    head = (None, 0, 0)
    for batch in batches:
        keep = []
        for win, doc, a in zip(*(batch.column(n).to_pylist() for n in ("win", "doc", "a"))):
            if win != head[0]:
                head = (win, doc, a)
            keep.append((doc, a) != head[1:])
        yield batch.filter(pa.array(keep, pa.bool_())).select([n for n, _ in _RUNS])


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = 20, prefix: int = 8, group_rows: int = 100_000) -> DataFrame:
    """doc, t1, a, b: runs of starts of windows that begin earlier elsewhere; ``docs`` has doc, t1 (a hash of the text) and text, each text once."""
    left = window - prefix
    hot = _hot_prefixes(docs, window, prefix, scratch)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            w = words(part.column(2), WHITE)
            text, place, _, _, h = anchors(w, window, prefix)
            keep = ~_among(h, hot)
            text, place, h = text[keep], place[keep], h[keep]
            doc, t1 = (part.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            pos = (place - w.first[text]).astype(np.int32)
            for s in range(0, len(pos), 50_000):
                e = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[e].view(np.int64)), *[pa.array(np.ascontiguousarray(x[e])) for x in (t1, pos, doc)]], names=["h", "t1", "pos", "doc"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted (h, t1, pos, doc), each text and place once, where a prefix has more than one."""
        held, out_of_group = None, False  # the last row kept, and whether its prefix has shown another
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            first = np.concatenate(([held is None or bool((rows[0] != held).any())], (rows[1:] != rows[:-1]).any(axis=1)))
            rows = rows[first]
            if held is not None:
                rows = np.concatenate((held[None], rows))
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.concatenate((same, [False])) | np.concatenate(([out_of_group], same))
            held, out_of_group = rows[-1].copy(), bool(keep[-1])
            rows = rows[:-1][keep[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (3, 1, 2)], names=["doc", "t1", "pos"])
        if held is not None and out_of_group:
            yield pa.RecordBatch.from_arrays([pa.array(held[k : k + 1]) for k in (3, 1, 2)], names=["doc", "t1", "pos"])

    found = docs.mapInArrow(find, "h long, t1 long, pos int, doc long").repartition("h").sortWithinPartitions("h", "t1", "pos", "doc")
    places = scratch.write(found.mapInArrow(shared, "doc long, t1 long, pos long"), "places")
    per_text = places.groupBy("doc", "t1").agg(F.collect_list("pos").alias("at"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            w = words(part.column(2), WHITE)
            text, place, lo, hi, h = anchors(w, window, prefix)
            want = np.concatenate([np.asarray(x, np.int64) + int(f) for x, f in zip(part.column(3).to_pylist(), w.first)] or [np.zeros(0, np.int64)])
            keep = np.isin(place, want)
            text, place, lo, hi, h = (x[keep] for x in (text, place, lo, hi, h))
            doc, t1 = (part.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            base, top = w.first[text], w.first[text + 1]
            first, last = np.maximum(place - left, base), np.minimum(place + window, top)
            spelled = _Spelled(part.column(2))
            for s in range(0, len(place), 10_000):
                e = slice(s, s + 10_000)
                cols = [h[e].view(np.int64), doc[e], t1[e], *[x.astype(np.int32) for x in ((place - base)[e], (lo - base)[e], (hi - base)[e], (place - first)[e], (last - place)[e])]]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in cols], pa.array(spelled.runs(first[e], last[e]), pa.binary())], names=_SUFFIX)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = None, None  # rows of the last prefix so far, and the prefix if parts of its group have gone
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if rest is None else pa.concat_batches([rest, batch])
            h = table.column("h").to_numpy()
            edge = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            if large is not None and h[0] == large and len(edge) > 2:  # the last part of a large group
                yield from whole(table.slice(0, edge[1]))
                edge = edge[1:]
            large = large if large is not None and h[edge[0]] == large else None
            if edge[-2] > edge[0]:
                yield tree(table.slice(edge[0], edge[-2] - edge[0]))
            rest = table.slice(edge[-2])
            if rest.num_rows > group_rows or large is not None:
                large = h[-1]
                yield from whole(rest)
                rest = None
        if rest is not None:
            yield tree(rest)

    def tree(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = _ints(part, ["doc", "t1", "pos", "lo", "hi", "before", "after"])
        flags = _window_flags(rows, _numbered(part.column("ctx").to_pylist(), rows["before"], rows["after"], left, window), window, prefix)
        return _told(rows["doc"][flags[:, 0]], rows["t1"][flags[:, 0]], flags[:, 1])

    def whole(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A part of a large group: what repeats within it is told here; the first of each window goes on, with its words."""
        rows = _ints(part, ["doc", "t1", "pos", "lo", "hi", "before", "after"])
        ctx = part.column("ctx").to_pylist()
        flags = _window_flags(rows, _numbered(ctx, rows["before"], rows["after"], left, window), window, prefix)
        yield _told(rows["doc"][flags[:, 0]], rows["t1"][flags[:, 0]], flags[:, 1])
        told = set(map(tuple, flags.tolist()))
        row, start, win = [], [], []
        for k, (pos, lo, hi, before) in enumerate(zip(*(rows[n].tolist() for n in ("pos", "lo", "hi", "before")))):
            spelled = ctx[k].split(b" ")
            for at in range(lo, hi + 1):
                if (k, at) not in told:
                    row.append(k)
                    start.append(at)
                    win.append(b" ".join(spelled[at - pos + before : at - pos + before + window]))
        for k in range(0, len(row), 20_000):
            r = np.array(row[k : k + 20_000], np.int64)
            yield _asked(rows["doc"][r], rows["t1"][r], np.array(start[k : k + 20_000]), win[k : k + 20_000])

    def below_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            yield from _windows_in_part(part, hot, window, prefix)

    joined = docs.join(per_text, ["doc", "t1"]).select("doc", "t1", "text", "at")
    types = ["long"] * 3 + ["int"] * 5 + ["binary"]
    dealt = joined.mapInArrow(suffixes, ", ".join(f"{n} {t}" for n, t in zip(_SUFFIX, types))).repartition("h").sortWithinPartitions("h", "doc", "pos")
    told = scratch.write(dealt.mapInArrow(trees, _TOLD), "windows")
    scratch.drop(places)
    if len(hot):
        told = told.unionAll(scratch.write(docs.mapInArrow(below_hot, _TOLD), "below-hot"))
    asked = told.where("win IS NOT NULL").repartition("win").sortWithinPartitions("win", "doc", "a")
    return told.where("win IS NULL").drop("win").unionAll(asked.mapInArrow(_later, "doc long, t1 long, a int, b int"))


_SUFFIX = ["h", "doc", "t1", "pos", "lo", "hi", "before", "after", "ctx"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, prefix: int = 8, group_rows: int = 100_000, kept_col: str | None = "kept", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the text column, with n_words, n_removed, kept_sha256 and, as ``kept_col``, the kept words joined by one space.

    A text that loses nothing is kept as it is. With ``kept_col`` the result is not
    checkpointed, and reads one small table of ``scratch``, which the caller drops.
    """
    own = Scratch(docs.sparkSession, "substrings")
    news = ["n_words", "n_removed", "kept_sha256", *([kept_col] if kept_col else [])]
    keep = [c for c in docs.columns if c != text_col and c not in news]
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.coalesce(F.col(text_col), F.lit(""))
    t1 = F.xxhash64(text)
    plain = docs.select(doc.alias("doc"), t1.alias("t1"), text.alias("text")).where(F.octet_length("text") >= 2 * window - 1)
    ids = own.write(plain.select("doc", "t1", F.unhex(F.sha2("text", 256)).alias("key")).groupBy("key", "doc", "t1").agg(F.count("*").alias("rows")), "ids")
    least = ids.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    least = own.write(least.where("n > 1"), "least")
    copies = join_with_hot_keys(ids, least, "key", "n", ids.count()).where("doc != least").select("doc", "t1")
    copies = own.write(copies, "copies")
    searched = own.write(plain.join(copies, ["doc", "t1"], "left_anti"), "searched")
    found = repeated_windows(searched, own, window, prefix, group_rows)
    cut = found.groupBy("doc", "t1").agg(F.collect_list(F.struct("a", "b")).alias("cut"))
    facts = cut.select(F.col("doc").alias("__doc"), F.col("t1").alias("__t1"), F.lit(False).alias("copy"), "cut")
    facts = facts.unionAll(copies.select("doc", "t1", F.lit(True), F.lit(None).cast(facts.schema["cut"].dataType)))
    stays = bool(scratch or kept_col)
    facts = ((scratch or Scratch(docs.sparkSession, "repeats")) if stays else own).write(facts, "facts")
    whole = docs.select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(keep)], doc.alias("__doc"), t1.alias("__t1"), text.alias("text"))
    whole = whole.join(facts, ["__doc", "__t1"], "left").select(*[f"p{k}" for k in range(len(keep))], F.coalesce("copy", F.lit(False)).alias("copy"), "cut", "text")
    n = len(keep)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), n + 2):
                out = []
                for copy, cuts, t in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist()):
                    w = t.encode("utf-8", "surrogatepass").split()
                    if copy and len(w) >= window:
                        out.append((len(w), len(w), b""))
                    elif copy or not cuts:
                        out.append((len(w), 0, b" ".join(w), t))
                    else:
                        gone = np.zeros(len(w) + 1, np.int64)
                        np.add.at(gone, [c["a"] for c in cuts], 1)
                        np.add.at(gone, [c["b"] + window for c in cuts], -1)
                        gone = np.cumsum(gone[:-1]) > 0
                        a, b = runs(~gone)
                        out.append((len(w), int(gone.sum()), b" ".join(x for i, j in zip(a.tolist(), b.tolist()) for x in w[i : j + 1])))
                cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out])]
                if kept_col:
                    cols.append(pa.array([x[3] if len(x) > 3 else x[2].decode("utf-8", "replace") for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(n)], *cols], names=[*[f"p{k}" for k in range(n)], *[f"q{k}" for k in range(len(cols))]])

    types = [f"p{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)] + ["q0 long", "q1 long", "q2 string", *(["q3 string"] if kept_col else [])]
    out = whole.mapInArrow(finish, ", ".join(types)).toDF(*keep, *news)
    if not stays:
        return own.finish(out)
    own.drop()
    return out


def op7_suffix_tree_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text"), kept_col=None)
