"""One document of each group of near copies: five-word sets whose Jaccard similarity is 0.8 or more, linked.

Equal texts are one class. A class has the 64-bit SimHash fingerprint of its runs of five
words, and the covering tables of ``simhash.py`` give the pairs of fingerprints that differ
in at most RADIUS bits. A pair counts if the whole sets are similar. Most pairs of
similarity 0.8 lie 4 to 11 bits apart, so what those tables have not linked is looked for
further: the runs of a class are ordered rarest first; two sets of similarity t share one of
their first n - ceil(t n) + 1 runs (prefix filtering; Chaudhuri et al., 2006), so the classes
meet in the buckets of those runs. A meeting counts if place and size allow t (Xiao et
al., 2008) and if the folded fingerprints, the parity of the runs in each of 256 bits,
differ in no more bits than runs may differ. 256 bits tell little of sets of over 500 runs,
so each class also has a sketch, such parities in as many bits as it has runs, which a pair
is compared by before any text is moved for it. None of these filters loses a pair, and a
pair that is left is counted by its whole sets unless its classes are connected already.

Pairs are counted in turns, each with the components of the turn before: those of the
covering tables, one for each class (with the least class that it met), and the rest. The
texts of a turn's classes are picked from the documents by a table of at most BITS bits before they
are shuffled, so a turn moves the texts that it compares and few others.

Runs that one class alone has among its first ones are dropped before anything else goes
with them. Buckets of over CENTRES + 1 classes first meet their least CENTRES classes
only (those of the smallest ids, of which the others mostly are copies), as a stream. In buckets that are not one component yet, each class then meets the
nearest one, by the bits, of another component, in ROUNDS rounds with new components
each; then what is left of the pairs of different components. A row that met no class of
another component in one round meets none in the next, as components only grow, so a round
has the rows that met one in the round before. From the second round on sets of over 256
runs come with their sketches, folded to NARROW bits, and meet only if those allow it too: else
long unlike texts that share a passage would meet in the bucket of each of its runs, in
every round, and in all pairs in the last. The first round gives a row for each that it is dealt,
at most. A bucket is worked off in
blocks of at most BLOCK classes, two blocks in a task. So a group of near copies gives
pairs in proportion to its size; a bucket of many unlike classes costs the square of its
size in bit counts, not in pairs. The order of runs is by their counts in a sample of at most SAMPLE texts; that bears on cost
only, as any one order gives the same pairs.

Defined results: null, empty and blank texts are equal; a text of under five words is one
run; rows with a null id are members like others, kept only where no other id is there;
rows that share an id but not a text are two documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.simhash import fingerprint, link_fingerprints, shingle_hashes
from pairloom.plans.graph import connected_components
from pairloom.plans.hot import join_with_hot_keys
from pairloom.plans.scratch import Scratch

RADIUS, SAMPLE, HOT, CENTRES, ROUNDS, BLOCK = 3, 20_000, 300_000, 2, 2, 8192
#: Of the table that texts are picked by, at most, and the keys up to which it is of use.
BITS, KEYS = 1 << 26, 1 << 22
#: Bits of a sketch, the least and the most.
SKETCH = (256, 1 << 16)
#: Bits to which a sketch is folded where it goes with a row of a bucket, and bytes of sketches compared at once.
NARROW, COMPARED = 1 << 14, 1 << 23
#: Rows of texts or sets that a worker has in memory at once.
SLICE = 256
PLACE = ["token", "cls", "pos"]
ROW = ["token", "cls", "n", "pos", "b0", "b1", "b2", "b3"]
LONGS = ", ".join(f"{c} long" for c in ROW)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def word_set(text: str | None) -> np.ndarray:
    """Hashes of the runs of five words, sorted, once each; zero stands for no words."""
    got = np.unique(shingle_hashes(text, 5))
    return got if len(got) else np.zeros(1, np.uint64)


def folded(words: np.ndarray) -> np.ndarray:
    """Parity of the hashes in each of 256 bits, as four longs."""
    return np.packbits((np.bincount((words >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def sketch(words: np.ndarray) -> bytes:
    """Parity of the hashes in each of at least as many bits as there are hashes, a power of two; SKETCH bounds it."""
    bits = min(max(SKETCH[0], 1 << (len(words) - 1).bit_length()), SKETCH[1])
    return np.packbits((np.bincount((words & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded to the other's bits first."""
    one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(one) > len(two):
        one, two = two, one
    two = np.bitwise_xor.reduce(two.reshape(-1, len(one)), axis=0)
    return int(np.bitwise_count(one ^ two).sum())


def similar(shared, total):
    """Whether ``shared`` of two sets of ``total`` runs together make a similarity of 0.8."""
    return 9 * shared >= 4 * total


def _first(words: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(words)
    at = np.searchsorted(hot, words)
    at[at == len(hot)] = 0
    often = np.where(hot[at] == words, counts[at], 0) if len(hot) else at
    return words[np.lexsort((words, often))][: n - (4 * n + 4) // 5 + 1]


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The runs that a sample of the texts has most often, sorted, and their counts."""
    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            got = [word_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))], names=["token"])

    once = part.groupBy("h").agg(F.first("text").alias("text")).select("text")
    top = once.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "token").limit(HOT).toPandas()
    hot, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(hot)
    return hot[order], counts[order]


def _marked(texts: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [word_set(t.as_py()) for t in batch.column(2)]
            bits = np.array([folded(w) for w in sets], np.int64).reshape(-1, 4)
            first = [_first(w, hot, counts).tobytes() for w in sets]
            fps = np.array([fingerprint(w) for w in sets], np.uint64).view(np.int64)
            cols = [pa.array([len(w) for w in sets], pa.int64()), pa.array(fps), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)], pa.array(first, pa.binary())]
            cols.append(pa.array([sketch(w) for w in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "h", "n", "fp", "b0", "b1", "b2", "b3", "first", "sketch"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, h string, n long, fp long, b0 long, b1 long, b2 long, b3 long, first binary, sketch binary")


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of PLACE for each of a class's first runs."""
    for batch in _slices(batches):
        first = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
        size = np.array([len(x) for x in first], np.int64)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield _batch(np.column_stack((np.concatenate([np.zeros(0, np.int64), *first]), np.repeat(batch.column(0).to_numpy(), size), pos)), PLACE)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token another row has."""
    held, twice = np.zeros((0, 3), np.int64), False  # the last row, and whether its token has shown another
    for batch in batches:
        rows = np.concatenate((held, _table(batch)))
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.concatenate(([twice], same)) | np.concatenate((same, [False]))
        held, twice = rows[-1:], bool(keep[-1])
        yield _batch(rows[:-1][keep[:-1]], PLACE)
    if twice:
        yield _batch(held, PLACE)


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y, by broadcasting, can be near copies."""
    total = x[..., 2] + y[..., 2]
    ok = similar(np.minimum(x[..., 2] - x[..., 3], y[..., 2] - y[..., 3]), total)
    apart = sum(np.bitwise_count((x[..., k] ^ y[..., k]).view(np.uint64)).astype(np.int64) for k in (4, 5, 6, 7))
    return ok & (9 * apart <= total)


def _pairs_and_rows(pairs: list[np.ndarray], back: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (a, b) without ROW, and ROW without a and b."""
    ab, rows = np.concatenate([np.zeros((0, 2), np.int64), *pairs]), np.concatenate([np.zeros((0, 8), np.int64), *back])
    n, m = len(ab), len(rows)
    cols = [pa.concat_arrays([pa.array(np.ascontiguousarray(ab[:, k])), pa.nulls(m, pa.int64())]) for k in (0, 1)]
    cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(rows[:, k]))]) for k in range(8)]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", *ROW])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with the least classes of each bucket, and the rows of buckets that have other pairs.

    Rows are sorted by token, then class; of a bucket that goes on no more than its least
    classes are held.
    """
    centres, large = np.zeros((0, 8), np.int64), False  # of the bucket that may go on, and whether its rows go back
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _table(batch)
        if len(centres) and centres[0, 0] != rows[0, 0]:
            centres, large = centres[:0], False
        edge = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist(), len(rows)]
        pairs, back = [], []
        for x, y in zip(edge[:-1], edge[1:]):
            bucket = rows[x:y] if x else np.concatenate((centres, rows[x:y]))
            known = len(centres) if not x else 0
            if not x and large:  # all that came before has gone back
                fresh = bucket[known:]
            else:
                fresh, large = bucket, len(bucket) > CENTRES + 1
            if large:
                back.append(fresh)
            for k in range(min(CENTRES, len(bucket) - 1)):
                against = bucket[max(k + 1, known) :]
                hit = against[_meet(bucket[k], against), 1]
                if len(hit):
                    pairs.append(np.column_stack((np.full(len(hit), bucket[k, 1]), hit)))
            centres = bucket[: CENTRES if large else CENTRES + 1]
        yield _pairs_and_rows(pairs, back)


def _others(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of classes that are not connected yet, of each two blocks of a bucket; rows are ROW, c, own, i, j and may have a sketch.

    ``nearest``: of each class only that with the fewest differing bits, the least of equals,
    in one row with the class's own ROW.
    """
    rest, marks = np.zeros((0, 12), np.int64), np.zeros(0, object)
    for batch in _ended(batches):
        rows = rest
        if batch is not None:
            rows, marks = np.concatenate((rest, _table(batch.select(range(12))))), np.concatenate((marks, _sketches(batch)))
        cut = np.flatnonzero((rows[1:, [0, 10, 11]] != rows[:-1, [0, 10, 11]]).any(axis=1)) + 1
        edge = [0, *cut.tolist(), *([len(rows)] if batch is None and len(rows) else [])]
        for a, b in zip(edge[:-1], edge[1:]):
            yield from _between(rows[a:b], marks[a:b], nearest)
        rest, marks = rows[edge[-1] :], marks[edge[-1] :]


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    """The sketch of each row, of at most NARROW bits, or None."""
    out = np.full(batch.num_rows, None, object)
    for k, x in enumerate(batch.column(12) if batch.num_columns > 12 else ()):
        if x.is_valid:
            got = np.frombuffer(x.as_py(), np.uint64)
            out[k] = np.bitwise_xor.reduce(got.reshape(-1, min(len(got), NARROW // 64)), axis=0)
    return out


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _by_width(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sketches of over 256 bits, folded to 512 bits, 1024 and so on: which rows have that many, and a table of theirs."""
    size = np.array([0 if x is None else len(x) for x in marks], np.int64)
    words = 8
    while (at := np.flatnonzero(size >= words)).size > 1:
        yield at, np.stack([np.bitwise_xor.reduce(marks[k].reshape(-1, words), axis=0) for k in at])
        words *= 2


def _unlike(i: np.ndarray, j: np.ndarray, total: np.ndarray, widths: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of the pairs (i, j) have sketches that differ in more bits than runs may differ; fewer bits are compared first."""
    out = np.zeros(len(i), bool)
    for at, table in widths:
        step = max(1, COMPARED // table[0].nbytes)
        left = np.flatnonzero(~out & np.isin(i, at) & np.isin(j, at))
        for k in range(0, len(left), step):
            one = left[k : k + step]
            apart = np.bitwise_count(table[np.searchsorted(at, i[one])] ^ table[np.searchsorted(at, j[one])]).sum(axis=1, dtype=np.int64)
            out[one] = 9 * apart > total[one]
    return out


def _between(rows: np.ndarray, marks: np.ndarray, nearest: bool) -> Iterator[pa.RecordBatch]:
    every = np.arange(len(rows))
    mine = every[rows[:, 9] == rows[0, 10]]
    within = rows[0, 10] == rows[0, 11]
    theirs = mine if within else every[rows[:, 9] == rows[0, 11]]
    if nearest:
        mine = theirs = every
    block = max(1, (1 << 18) // max(len(theirs), 1))
    widths = list(_by_width(marks))
    for at in range(0, len(mine), block):
        own, other = mine[at : at + block], theirs[at if within and not nearest else 0 :]
        x, y = rows[own, None], rows[None, other]
        ok = _meet(x, y) & (x[..., 8] != y[..., 8])
        if not nearest and within:
            ok = np.triu(ok, 1)
        if widths:
            i, j = np.nonzero(ok)
            no = _unlike(own[i], other[j], rows[own[i], 2] + rows[other[j], 2], widths)
            ok[i[no], j[no]] = False
        if nearest:
            apart = np.where(ok, sum(np.bitwise_count((x[..., k] ^ y[..., k]).view(np.uint64)).astype(np.int64) for k in (4, 5, 6, 7)), 1 << 20)
            i = np.flatnonzero(ok.any(axis=1))
            j = apart[i].argmin(axis=1)
        else:
            i, j = np.nonzero(ok)
        if len(i):
            pairs = np.sort(np.column_stack((rows[own[i], 1], rows[other[j], 1])), axis=1)
            yield _batch(np.column_stack((pairs, rows[own[i], :8])), ["a", "b", *ROW]) if nearest else _pairs_and_rows([pairs], [])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches differ in no more bits than runs may differ; rows are a, b, n and sketch of each."""
    for batch in batches:
        total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
        ok = [9 * bits_apart(x.as_py(), y.as_py()) <= t for x, y, t in zip(batch.column(3), batch.column(5), total)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts whose whole sets are similar; rows mostly come sorted by a."""
    last, x = None, None
    for batch in _slices(batches):
        ok = []
        for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, x = a, word_set(one.as_py())
            y = word_set(two.as_py())
            ok.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _marks(keys: DataFrame) -> np.ndarray | None:
    """A table with the bits set that the keys, one column of longs, fall on; None if they are too many for it to tell."""
    n = keys.count()
    if n > KEYS:
        return None
    size = min(BITS, max(1 << 16, 1 << (16 * n).bit_length()))  # every task that picks holds it
    at = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(size)).alias("k")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _picked(rows: DataFrame, key: str, bits: np.ndarray | None, marked: bool = True) -> DataFrame:
    """Of ``rows`` those whose long ``key`` falls on a set bit, or on none; without a table all rows are marked."""
    if bits is None:
        return rows if marked else rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy() & (8 * len(bits) - 1)
            yield batch.filter(pa.array(((bits[at >> 3] >> (at & 7)) & 1 == 1) == marked))

    return rows.mapInArrow(run, rows.schema)


def _dealt(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(run, schema)


def _fingerprint_pairs(classes: DataFrame, own: Scratch) -> DataFrame:
    """(a, b): pairs of classes that connect all whose fingerprints differ in at most RADIUS bits."""
    alike = own.write(classes.groupBy("fp").agg(F.min("cls").alias("least"), F.count("*").alias("n_rows")), "alike")
    links = link_fingerprints(alike.select("fp", "least"), own, RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = join_with_hot_keys(classes.select("fp", "cls"), alike.where("n_rows > 1"), "fp", "n_rows", classes.count())
    return own.write(links.unionAll(same.where("least < cls").select("least", "cls")).distinct(), "tables")


def _unconnected(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    ends = [joined.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _joined_by(links: DataFrame, joined: DataFrame | None, own: Scratch) -> DataFrame:
    """(id, component) of every class on a link so far: those of ``joined``, connected by the further ``links``."""
    if joined is None:
        return own.write(connected_components(links, own), "connected")
    if not links.take(1):
        return joined
    ends = [joined.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    now = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    now = own.write(connected_components(now, own), "connected")
    later = joined.join(now.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select("id", F.coalesce("c", "component").alias("component"))
    return own.write(later.unionAll(now.join(joined, "id", "left_anti")), "connected")


def near_copy_components(docs: DataFrame, own: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, h) of every row, and (h, least, component) of every text, h: its MD5, least: its smallest id."""
    texts = docs.select(docs[id_col].alias("id"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("h"), docs[text_col].alias("text"))
    marked = own.write(_marked(texts, *_frequent(texts)), "marked")
    classes = marked.groupBy("h").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "b0", "b1", "b2", "b3")])
    # numbered in the order of ids, as copies mostly come after what they were made of: so that is a bucket's least class
    order = [F.col("least").asc_nulls_last(), F.col("h").asc()]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = classes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    classes = own.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows = own.write(marked.select("id", "h"), "rows")
    sketches = marked.groupBy("h").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(classes.select("h", "cls"), "h")
    sketches = own.write(sketches.select(F.xxhash64("cls").alias("k"), "cls", "n", "sketch"), "sketches")
    firsts = marked.groupBy("h").agg(F.first("first").alias("first")).join(classes.select("h", "cls"), "h").select("cls", "first")
    places = _dealt(firsts.mapInArrow(_places, "token long, cls long, pos long"), _met, "token long, cls long, pos long")
    places = own.write(places, "places")
    own.drop(marked)
    sizes = classes.select("cls", "n", "b0", "b1", "b2", "b3")
    met = own.write(_dealt(places.join(sizes, "cls").select(*ROW), _spread, f"a long, b long, {LONGS}"), "met")
    own.drop(places)
    pairs = own.write(met.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    large = met.where("cls IS NOT NULL").select(*ROW)

    def counted(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar; only texts that stand in pairs are read again, and only of pairs with like sketches."""
        ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct()
        some = _picked(sketches, "k", _marks(ends.select(F.xxhash64("cls"))))
        x, y = some.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), some.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        pairs = own.write(pairs.join(y, "b").join(x, "a").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_likely, "a long, b long"), "likely")
        need = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct()
        wanted = own.write(classes.select("h", "cls").join(need, "cls"), "wanted")
        found = _picked(texts.select(F.xxhash64("h").alias("k"), "h", "text"), "k", _marks(wanted.select(F.xxhash64("h"))))
        held = own.write(found.join(wanted, "h").groupBy("cls").agg(F.first("text").alias("text")), "held")
        x, y = held.select(F.col("cls").alias("a"), F.col("text").alias("x")), held.select(F.col("cls").alias("b"), F.col("text").alias("y"))
        out = own.write(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_count, "a long, b long"), "links")
        own.drop(wanted)
        own.drop(held)
        return out

    tried = _fingerprint_pairs(classes, own)
    joined = _joined_by(counted(tried), None, own)
    for least_only in (True, False):
        left = own.write(_unconnected(pairs.join(tried, ["a", "b"], "left_anti"), joined), "left")
        if not left.take(1):
            break
        if least_only:
            left = own.write(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tree")
        tried = tried.unionAll(left)
        joined = _joined_by(counted(left), joined, own)
    for turn in range(ROUNDS + 1 if large.take(1) else 0):
        placed = large.join(joined, large["cls"] == joined["id"], "left").select(*ROW, F.coalesce("component", "cls").alias("c"))
        placed = own.write(placed, "placed")
        open_ = placed.groupBy("token").agg(F.count("*").alias("n_rows"), F.min("c").alias("c1"), F.max("c").alias("c2"))
        open_ = own.write(open_.where("c1 != c2").withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK)).select("token", "n_rows", "blocks"), "open")
        blocked = join_with_hot_keys(placed, open_, "token", "n_rows", placed.count()).where("blocks IS NOT NULL")
        blocked = blocked.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        blocked = blocked.select(*ROW, "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        if turn:
            few = blocked.where(F.col("n") > SKETCH[0]).select("cls").distinct()
            few = _picked(sketches, "k", _marks(few.select(F.xxhash64("cls")))).where(F.col("n") > SKETCH[0]).select("cls", "sketch")
            blocked = blocked.join(few, "cls", "left").select(*blocked.columns, "sketch")
        dealt = blocked.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "cls")
        more = own.write(dealt.mapInArrow(partial(_others, nearest=turn < ROUNDS), f"a long, b long, {LONGS}"), "others")
        own.drop(placed)
        own.drop(open_)
        large = more.where("cls IS NOT NULL").select(*ROW).distinct()
        more = more.select("a", "b").distinct()
        if not more.take(1):
            break
        more = own.write(more.join(tried, ["a", "b"], "left_anti"), "untried")
        if more.take(1):
            tried = tried.unionAll(more)
            joined = _joined_by(counted(more), joined, own)
    out = classes.join(joined, classes["cls"] == joined["id"], "left").select("h", "least", F.coalesce("component", "cls").alias("component"))
    return rows, own.write(out, "components")


def keep_one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The row of ``docs`` with the smallest id of each group of near copies, as it came.

    The result reads one small table of the scratch, which the caller drops.
    """
    own = Scratch(docs.sparkSession, "near")
    rows, found = near_copy_components(docs, own, id_col, text_col)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "h")).alias("best"))
    kept = own.write(best.select(F.col("best.h").alias("h"), F.col("best.least").alias("least")), "kept")
    sizes = rows.groupBy("h").agg(F.count("*").alias("n_rows"))
    each = own.write(rows.groupBy("id", "h").agg(F.count("*").alias("n")), "each")
    facts = sizes.join(kept, "h").select("h", "n_rows", "least", F.lit(True).alias("is_kept"))
    each = join_with_hot_keys(each, own.write(facts, "facts"), "h", "n_rows", rows.count())
    each = each.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "n", (F.coalesce("is_kept", F.lit(False)) & F.col("id").eqNullSafe(F.col("least"))).alias("stays"))
    each = (scratch or Scratch(docs.sparkSession, "copies")).write(each.where("n > 1 OR NOT stays"), "ids")
    own.drop()
    keyed = docs.withColumns({"__k": F.xxhash64(id_col, F.md5(F.coalesce(text_col, F.lit(""))))})
    bits = _marks(each.select(F.xxhash64("__id", "__h")))
    # few rows go beside those that the join is about, so it moves few texts
    some, rest = _picked(keyed, "__k", bits).drop("__k"), _picked(keyed, "__k", bits, False).drop("__k")
    on = some[id_col].eqNullSafe(each["__id"]) & (F.md5(F.coalesce(some[text_col], F.lit(""))) == each["__h"])
    out = some.join(each, on, "left_anti").unionAll(rest)
    twice = each.where("stays")
    if twice.take(1):
        on = docs[id_col].eqNullSafe(twice["__id"]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == twice["__h"])
        again = docs.join(twice, on).groupBy("__id", "__h").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("r"))
        out = out.unionAll(again.select("r.*"))
    return out
