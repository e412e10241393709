"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by the chord between unit vectors, a metric that
falls as the cosine rises. A cover tree's node has a centre, the radius that covers
its points, and children within half of its level's radius; centres of one level are
further apart than that radius. Two trees are walked together: a pair of nodes is
dropped if the centres are further apart than the threshold and both radii together,
and taken whole if even their furthest points are near enough. Pairs of nodes with few
points are not walked further: their points are verified, many node pairs at once, by
the cosine in double precision.

Equal vectors are one class with a count. Classes of a label are dealt to cells of
nearest pivots, and cells to blocks of about ``block_rows``; a task compares two
blocks, and pairs of cells that the pivots' triangle inequality rules out get none.
So a label of any size is split, and no task holds more than two blocks. A task gives
counts and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing; neither do vectors of
different lengths. Repeated vectors link with each other. A vector with a null id links
and is counted like any other, but a null is no smallest id: its component is the
smallest id that it reaches, null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.graph import connected_components
from pairloom.plans.scratch import Scratch

SLACK = 1e-6  # more than rounding can move a chord
FEW = 1024  # a pair of nodes with no more point pairs is verified, not walked


class CoverTree:
    """Over unit rows of x: arrays by node, with each node's points a run of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = 8):
        self.x, self.leaf = x, leaf
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        self.order = np.empty(len(x), np.int64)
        self._filled = 0
        idx = np.arange(len(x))
        todo = [(idx, self._far(idx, 0), 0, -1)]
        kids: dict[int, list[int]] = {}
        while todo:
            idx, far, center, parent = todo.pop()
            node = len(self.center)
            self.center.append(center)
            self.radius.append(float(far.max()))
            self.span.append((0, 0))
            kids[node] = []
            if parent >= 0:
                kids[parent].append(node)
            if len(idx) <= leaf or self.radius[node] <= SLACK:
                self.span[node] = (self._filled, self._filled + len(idx))
                self.order[self._filled : self._filled + len(idx)] = idx
                self._filled += len(idx)
                continue
            half = 2.0 ** (math.ceil(math.log2(self.radius[node])) - 1)
            rest = np.concatenate(([center], idx[idx != center]))
            while len(rest):
                c = int(rest[0])
                d = self._far(rest, c)
                near = d <= half
                near[0] = True
                todo.append((rest[near], d[near], c, node))
                rest = rest[~near]
        self.children = [np.array(kids[n], np.int64) for n in range(len(self.center))]
        for n in range(len(self.center) - 1, -1, -1):
            if len(self.children[n]):
                spans = [self.span[c] for c in self.children[n]]
                self.span[n] = (min(a for a, _ in spans), max(b for _, b in spans))
        self.center_, self.radius_ = np.array(self.center, np.int64), np.array(self.radius)
        self.first_, ends = np.array(self.span, np.int64).T
        self.size_ = ends - self.first_

    def _far(self, idx: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[idx] @ self.x[c]), 0))

    def points(self, node: int) -> np.ndarray:
        a, b = self.span[node]
        return self.order[a:b]


class Links:
    """Counts of links by point, weighted, and a forest of what they connect."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), list(range(len(weight)))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def tie(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        for i, j in zip(a.tolist(), b.tolist()):
            self.tie(i, j)

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        for i in [*a.tolist(), *b.tolist()]:
            self.tie(int(a[0]), i)

    def all_within(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        for i in a.tolist():
            self.tie(int(a[0]), i)


def dual_traversal(p: CoverTree, q: CoverTree | None, at: tuple[np.ndarray, np.ndarray], raw: np.ndarray, norm: np.ndarray, least_cosine: float, links: Links) -> None:
    """All links between the trees, or within p if q is None; ``at``: where each tree's points are in raw."""
    chord = math.sqrt(2 - 2 * least_cosine)
    other = q or p
    ap, aq = at

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), 1 << 16):
            i, j = ap[a[s : s + (1 << 16)]], aq[b[s : s + (1 << 16)]]
            ok = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= least_cosine
            links.pairs(i[ok], j[ok])

    def verify_nodes(u: np.ndarray, v: np.ndarray) -> None:
        """All points of each node of u with all of its partner of v; of a node with itself, each pair once."""
        size_u, size_v = p.size_[u], other.size_[v]
        ends = np.cumsum(size_u * size_v)
        first = 0
        while first < len(u):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + FEW * FEW, "right")))
            k = slice(first, last)
            n = size_u[k] * size_v[k]
            pair = np.repeat(np.arange(last - first), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = p.first_[u[k]][pair] + within // size_v[k][pair]
            j = other.first_[v[k]][pair] + within % size_v[k][pair]
            if q is None:
                once = (u[k] != v[k])[pair] | (i < j)
                i, j = i[once], j[once]
            verify(p.order[i], other.order[j])
            first = last

    def below(t: CoverTree, n: int) -> np.ndarray:
        return t.children[n] if len(t.children[n]) else np.array([n])

    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        same = q is None and a == b
        if same and 2 * p.radius[a] <= chord - SLACK:
            links.all_within(ap[p.points(a)])
            continue
        if p.size_[a] * other.size_[b] <= FEW or not len(p.children[a]) and not len(other.children[b]):
            verify_nodes(np.array([a]), np.array([b]))
            continue
        ca, cb = below(p, a), below(other, b)
        for s in range(0, len(ca), 512):
            part = ca[s : s + 512]
            d = np.sqrt(np.maximum(2 - 2 * (p.x[p.center_[part]] @ other.x[other.center_[cb]].T), 0))
            reach = p.radius_[part][:, None] + other.radius_[cb][None, :]
            near = d <= chord + reach + SLACK
            if same:
                near &= np.arange(s, s + len(part))[:, None] <= np.arange(len(cb))[None, :]
            i, j = np.nonzero(near)
            u, v = part[i], cb[j]
            inner = d[i, j] + reach[i, j] <= chord - SLACK
            if same or q is None:
                inner &= u != v
            for x, y in zip(u[inner].tolist(), v[inner].tolist()):
                links.all_between(ap[p.points(x)], aq[other.points(y)])
            few = ~inner & (p.size_[u] * other.size_[v] <= FEW)
            verify_nodes(u[few], v[few])
            left = ~inner & ~few
            todo += list(zip(u[left].tolist(), v[left].tolist()))


def _compare(raw: np.ndarray, weight: np.ndarray, side: np.ndarray, least_cosine: float) -> Links:
    """Links of one task: within side 0 where there is no side 1, else between the sides."""
    scale = np.abs(raw).max(axis=1, keepdims=True)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    unit = raw / scale
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    links = Links(weight)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    p = CoverTree(unit[a])
    if len(b):
        dual_traversal(p, CoverTree(unit[b]), (a, b), raw, norm, least_cosine, links)
    else:
        dual_traversal(p, None, (a, a), raw, norm, least_cosine, links)
    return links


def _rows(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False) if not column.offset else column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.93, block_rows: int = 4096, most_pivots: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col(vector_col)
    good = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    classes = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = scratch.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written once, so a class keeps its number
    top = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n_pivots = int(min(most_pivots, max(1, top // block_rows)))
    length = F.size("v")
    first = classes.orderBy(F.xxhash64("v"), "v").select("v").limit(n_pivots).collect() if n_pivots > 1 else []
    pivots = [np.array(r[0], np.float64) for r in first]
    pivots = np.array([x / np.sqrt(x @ x) for x in pivots if len(x) == len(pivots[0])]) if pivots else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, 4.0)
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(lengths == pivots.shape[1]) if len(pivots) else np.zeros(0, np.int64)
            if len(own):
                x = _rows(batch.column(1).take(pa.array(own)))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
                cell[own], far[own] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    kind = classes.schema["v"].dataType.simpleString()
    label_kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "v", "cls", "n").mapInArrow(assign, f"label {label_kind}, v {kind}, cls long, n long, cell int, far double").withColumn("dims", length)
    placed = scratch.write(placed, "placed")
    group = ["label", "dims"]
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("rows"), F.max("far").alias("reach")).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    cells = scratch.write(cells, "cells")
    blocked = placed.join(cells.select(*group, "cell", "blocks"), [*group, "cell"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    chord = math.sqrt(2 - 2 * least_cosine)
    one = cells.select(*group, F.col("cell").alias("c1"), F.col("reach").alias("r1"), F.col("blocks").alias("n1"))
    two = cells.select(*group, F.col("cell").alias("c2"), F.col("reach").alias("r2"), F.col("blocks").alias("n2"))
    tasks = one.join(two, group).where("c1 <= c2")
    if len(pivots):
        between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        apart = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(i, len(pivots))], "c1 int, c2 int, apart double")
        tasks = tasks.join(F.broadcast(apart), ["c1", "c2"], "left").where(F.col("apart").isNull() | (F.col("apart") <= F.col("r1") + F.col("r2") + chord + SLACK))
    tasks = tasks.withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1))).where("c1 < c2 OR b1 <= b2")
    key = [*group, "c1", "b1", "c2", "b2"]
    tasks = scratch.write(tasks.select(*key), "tasks")
    data = ["cls", "n", "v"]
    left = blocked.withColumnsRenamed({"cell": "c1", "block": "b1"}).join(tasks, [*group, "c1", "b1"]).select(*key, F.lit(0).alias("side"), *data)
    right = blocked.withColumnsRenamed({"cell": "c2", "block": "b2"}).join(tasks.where("c1 != c2 OR b1 != b2"), [*group, "c2", "b2"]).select(*key, F.lit(1).alias("side"), *data)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        weight, cls = table.column("n").to_numpy(), table.column("cls").to_numpy()
        vectors_ = table.column("v").combine_chunks()
        links = _compare(_rows(vectors_), weight, table.column("side").to_numpy(), least_cosine)
        got = [(i, links.top(i)) for i in np.flatnonzero(links.count).tolist()]
        i, r = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)
        return pa.table({"a": pa.array(cls[i], pa.int64()), "b": pa.array(cls[r], pa.int64()), "n": pa.array(links.count[i], pa.int64())})

    found = scratch.write(left.unionAll(right).groupBy(*key).applyInArrow(compare, "a long, b long, n long"), "found")
    counts = found.groupBy("a").agg(F.sum("n").alias("linked"))
    joined = connected_components(found.where("a != b"), scratch)
    facts = classes.join(counts, classes["cls"] == counts["a"], "left").join(joined, classes["cls"] == joined["id"], "left")
    facts = facts.select("label", "v", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    facts = scratch.write(facts, "facts")
    smallest = facts.groupBy("root").agg(F.min("least").alias("c"))
    facts = scratch.write(facts.join(smallest, "root").select("label", "v", "n_links", "c"), "reached")
    linked = rows.where("good").join(facts, ["label", "v"]).select("vec_id", "n_links", F.col("c").alias("component_id"))
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return scratch.finish(linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op3_cover_tree_pairs(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
