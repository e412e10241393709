"""SimHash near-duplicates by covering locality-sensitive hashing.

A random map gives each fingerprint bit a vector of radius + 1 bits; for each nonzero
vector v there is a table whose mask holds the bits that are not orthogonal to v. Two
fingerprints that differ in at most ``radius`` bits have a v orthogonal to all the
differing bits' vectors, so they agree under that mask and meet in that table (Pagh,
2016). Nothing within the radius is missed, and nothing beyond it is linked, as every
meeting is verified.

Equal fingerprints are one class, taken before the tables. A bucket is not expanded
into pairs: it is one task's group, and gives a spanning forest of its links. A bucket
of more than ``bucket_rows`` classes is first split by the same construction over the
bits that its mask leaves free, again and again, so a group in memory stays bounded.

Defined results: a null text has no words, and a text without words has fingerprint
zero, linked like any other; a shorter text than a shingle is one shingle; texts of any
length are taken whole; repeated documents share a class; of tied ids the smallest names
a component; an empty table gives no rows; other columns are not read. A null id is no smallest id;
a fingerprint that only rows with null ids have is linked with nothing (component null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.graph import connected_components
from pairloom.plans.scratch import Scratch


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``size`` words, A-Z lower-cased, joined by one space."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    whole = b" ".join(got)
    if len(got) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    lengths = np.fromiter(map(len, got), np.int64, len(got)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    digest, view = xxhash.xxh64_intdigest, memoryview(whole)
    first, last = starts[: len(got) - size + 1].tolist(), (starts[size:] - 1).tolist()
    return np.array([digest(view[a:b], 42) for a, b in zip(first, last)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """2**(radius + 1) - 1 masks over the given bit places: of each, the bits whose vector is not orthogonal to v.

    The vectors are dealt evenly, in random order, so that no mask is much thinner than another.
    """
    size = 1 << (radius + 1)
    vectors = np.random.Generator(np.random.PCG64(seed)).permutation(np.resize(np.arange(1, size), len(bits)))
    return [sum(1 << b for b, m in zip(bits, vectors.tolist()) if (m & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of links that span what the links within the radius connect, for one bucket, in blocks of rows."""
    n = len(fp)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    block = max(1, (1 << 22) // n)
    for a in range(0, n, block):
        near = np.bitwise_count(fp[a : a + block, None] ^ fp[None, a:]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
            x, y = top(a + i), top(a + j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((a + i, a + j))
    return links


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, np.ndarray]]:
    """Runs of rows with equal (way, key), as arrays of way, key, held, fp, least.

    (True, rows): whole groups of at most ``most`` rows; (False, rows): rows of a larger group.
    """
    rest, large = np.zeros((0, 5), np.int64), None
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else rest[:0]
        rows = np.concatenate((rest, rows))
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        if large is not None:
            stop = cut[0] if len(cut) else len(rows)
            if (rows[0, :2] == large).all():
                yield False, rows[:stop]
                rows, cut = rows[stop:], cut[1:] - stop
            large = None if len(rows) else large
        whole = cut[-1] if len(cut) else 0
        if whole:
            yield True, rows[:whole]
        rest = rows[whole:]
        if len(rest) > most:
            large = rest[0, :2].copy()
            yield False, rest
            rest = rest[:0]
    if len(rest):
        yield True, rest


def _links(rows: np.ndarray, radius: int, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within whole groups, and the rows of those groups that are too large."""
    edge = np.concatenate(([0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1, [len(rows)]))
    size = np.diff(edge)
    fp = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
    two = edge[:-1][size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
    links = [np.column_stack((rows[two, 4], rows[two + 1, 4]))]
    large = []
    for k in np.flatnonzero(size > 2):
        a, b = edge[k], edge[k + 1]
        if b - a > most:
            large.append(rows[a:b])
            continue
        got = _forest(fp[a:b], radius)
        if got:
            links.append(rows[a:b, 4][np.array(got)])
    return links, large


def link_fingerprints(classes: DataFrame, scratch: Scratch, radius: int = 3, bucket_rows: int = 2000) -> DataFrame:
    """(a, b): links between the ``least`` of distinct fingerprints ``fp`` that connect all within the radius.

    A pass deals the rows by table and masked fingerprint, sorts them, and streams each
    task's buckets; the rows of too large buckets come out again for the next pass.
    """
    now = classes.select(F.lit(0).cast("long").alias("way"), F.lit(0).cast("long").alias("held"), "fp", "least")
    found: DataFrame | None = None
    names = ["way", "key", "held", "fp", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[np.ndarray], large: list[np.ndarray]) -> pa.RecordBatch:
            ab = np.concatenate([np.zeros((0, 2), np.int64), *links])
            back = np.concatenate([np.zeros((0, 5), np.int64), *large])
            n, m = len(ab), len(back)
            left = [pa.concat_arrays([pa.array(np.ascontiguousarray(ab[:, k])), pa.nulls(m, pa.int64())]) for k in (0, 1)]
            right = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(back[:, k]))]) for k in (0, 2, 3, 4)]
            return pa.RecordBatch.from_arrays([*left, *right], names=["a", "b", "way", "held", "fp", "least"])

        for whole, rows in _groups(batches, bucket_rows):
            yield out(*_links(rows, radius, bucket_rows)) if whole else out([], [rows])

    level = 0
    while True:
        masks = covering_masks(list(range(64)), radius, seed=1 + level)
        at = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t", "mask")
        held = F.col("held").bitwiseOR(F.col("mask"))
        way = F.col("way") * (len(masks) + 1) + F.col("t") + 1
        dealt = now.select("way", "held", "fp", "least", at).select(way.alias("way"), F.col("fp").bitwiseAND(held).alias("key"), held.alias("held"), "fp", "least")
        dealt = dealt.repartition("way", "key").sortWithinPartitions("way", "key", "fp")
        done = scratch.write(dealt.select(*names).mapInArrow(run, "a long, b long, way long, held long, fp long, least long"), f"level{level}")
        links = done.where("a IS NOT NULL").select("a", "b")
        found = links if found is None else found.unionAll(links)
        now = done.where("fp IS NOT NULL").select("way", "held", "fp", "least")
        if not now.take(1):
            return found
        level += 1


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket_rows: int = 2000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id: every row with the smallest id reachable by links."""
    own = scratch or Scratch(docs.sparkSession, "simhash")
    marked = own.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = own.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = link_fingerprints(classes.where("least IS NOT NULL"), own, radius, bucket_rows)
    joined = connected_components(links, own)
    classes = own.write(classes.join(joined, classes["least"] == joined["id"], "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    out = marked.join(classes, "fp").select("doc_id", "fp", "component_id")
    return own.finish(out) if scratch is None else out


def op8_covering_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
