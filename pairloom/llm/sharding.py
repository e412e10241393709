"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to equally deep cells, every row gets
the curve index of its cell, rows are ordered by that index, and the order is cut
into runs. Rows that are near in all dimensions lie in the same run, so the file
statistics of a run prune on any of the dimensions.

Equal texts are a group. They have one place on the curve, that of the smallest of their
rows' metadata, and lie side by side there, so of all groups only those that a border
between shards falls into (one a border at most) are in two shards.

Defined results: a null text has no bytes (size 1, crc 0); a null dimension sorts
as its smallest value; null texts are no group; repeated rows each get a slot of their
own, ties in the order of doc_id; an empty table gives no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.plans.hot import join_with_hot_keys
from pairloom.plans.scratch import Scratch


def hilbert_table(dims: int) -> list[int]:
    """For state and cell digit, the curve digit and next state, packed as next << dims | digit.

    A state is an entry corner and an axis, as in Hamilton's derivation: per level the
    digit is turned into the state's frame, read as a Gray code, and the entry corner
    and axis of the sub-cube that was found make the next state.
    """
    n, full = dims, (1 << dims) - 1

    def turn(x: int, k: int) -> int:  # rotate right by k within n bits
        k %= n
        return ((x >> k) | (x << (n - k))) & full

    def plain(g: int) -> int:  # the number whose Gray code is g
        out = 0
        while g:
            out, g = out ^ g, g >> 1
        return out

    def entry(w: int) -> int:
        if w == 0:
            return 0
        even = 2 * ((w - 1) // 2)
        return even ^ (even >> 1)

    def axis(w: int) -> int:
        if w == 0:
            return 0
        x = w if w % 2 else w - 1
        k = 0
        while x & 1:
            x, k = x >> 1, k + 1
        return k % n

    packed = []
    for corner in range(1 << n):
        for d in range(n):
            for digit in range(1 << n):
                w = plain(turn(digit ^ corner, d + 1))
                near = corner ^ turn(entry(w), -(d + 1))
                packed.append((near * n + (d + axis(w) + 1) % n) << n | w)
    return packed


def with_hilbert_index(df: DataFrame, cells: list[str], bits: int, name: str = "curve") -> DataFrame:
    """``df`` with the curve index of integer columns of 0 to 2**bits - 1.

    One column a level, each a single table lookup that two later columns read: so the
    optimizer keeps them apart, and a level is worked out once for a row.
    """
    n = len(cells)
    table = F.array(*[F.lit(x) for x in hilbert_table(n)])
    kept = df.columns
    state: Column = F.lit(0)
    for level in range(bits - 1, -1, -1):
        digit = F.lit(0)
        for k, c in enumerate(cells):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(c, level).bitwiseAND(F.lit(1)), k))
        df = df.withColumn(f"__level{level}", F.element_at(table, (state * F.lit(1 << n) + digit + F.lit(1)).cast("int")))
        state = F.shiftright(f"__level{level}", n)
    index = F.lit(0).cast("long")
    for level in range(bits):
        index = index.bitwiseOR(F.shiftleft(F.col(f"__level{level}").bitwiseAND(F.lit((1 << n) - 1)).cast("long"), n * level))
    return df.select(*kept, index.alias(name))


def _as_number(df: DataFrame, name: str, low, high) -> Column:
    """An order-keeping number for a column: strings by six bytes after the prefix that all values share."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
    shared = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    tail = F.rpad(F.hex(F.substring(F.encode(F.col(name), "utf-8"), shared + 1, 6)), 12, "0")
    return F.coalesce(F.conv(tail, 16, 10).cast("double"), F.lit(-1.0))


def _cell(number: Column, bounds: list[float]) -> Column:
    """How many of the bounds lie below a number."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(number > F.lit(float(b)), 1).otherwise(0)
    return out


def _metadata(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """What sharding needs of each row; the text itself is read once and not carried on."""
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    group = F.unhex(F.sha2(F.col(text_col), 256))
    kept = [F.col(d).alias(f"d{k}") for k, d in enumerate(dims)]
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), group.alias("group"), *kept)


def _with_dims_of_group(meta: DataFrame, axes: list[str], scratch: Scratch) -> DataFrame:
    """``meta`` with one set of dimensions for all rows of a group of equal texts; only groups whose rows differ in them are looked up."""
    own = F.struct(*axes)
    groups = meta.where("group IS NOT NULL").groupBy("group").agg(F.min(own).alias("of"), F.max(own).alias("top"), F.count("*").alias("n"))
    groups = scratch.write(groups.where(~F.col("of").eqNullSafe(F.col("top"))).select("group", "of", "n"), "groups")
    both = join_with_hot_keys(meta, groups, "group", "n", meta.count())
    of = F.coalesce("of", own)
    return both.select("doc_id", "size", "text_crc32", "group", *[of.getField(a).alias(a) for a in axes])


def hilbert_shards(docs: DataFrame, shards: int = 8, law: str = "rows", dims: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", bits: int = 5, runs: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, curve, rank, shard, slot for every row.

    law "rows": counts of the shards differ by one at most. law "bytes": a row goes to
    the shard in which the middle of its bytes falls. The text's size is a dimension
    besides ``dims``. ``runs``: how many ranges the order is sorted in, 0 for the
    session's number of shuffle partitions; one row for each is all that is broadcast.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    axes = [f"d{k}" for k in range(len(dims))]
    meta = scratch.write(_metadata(docs, id_col, text_col, list(dims)), "meta")
    meta = scratch.write(_with_dims_of_group(meta, axes, scratch), "grouped") if axes else meta
    ends = meta.agg(F.lit(0), *[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
    numbers = {a: _as_number(meta, a, ends[f"min_{a}"], ends[f"max_{a}"]) for a in axes} | {"size": F.col("size").cast("double")}
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    depth = meta.agg(*[F.percentile_approx(c, cuts, F.lit(10000)).alias(a) for a, c in numbers.items()]).first()
    tie = F.xxhash64("group").alias("tie")
    keyed = meta.select("doc_id", "size", "text_crc32", tie, *[c.alias(f"n_{a}") for a, c in numbers.items()])
    cells = [_cell(F.col(f"n_{a}"), depth[a] or []).alias(f"c_{a}") for a in numbers]
    keyed = with_hilbert_index(keyed.select("doc_id", "size", "text_crc32", "tie", *cells), [f"c_{a}" for a in numbers], bits)
    order = ["curve", "size", "text_crc32", "tie", "doc_id"]
    n = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.write(placed, "placed")
    run, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    runs_ = placed.groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("run").collect()
    rows, total, first = 0, 0, []
    for r in runs_:
        first.append((r["run"], rows, total))
        rows, total = rows + r["n"], total + r["b"]
    starts = F.broadcast(spark.createDataFrame(first, "run long, rows_before long, bytes_before long"))
    out = placed.withColumn("run", run).join(starts, "run")
    if law == "rows":
        out = out.withColumn("rank", F.col("rows_before") + within)
        out = out.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(rows, 1)}L as int)"))
        out = out.withColumn("slot", F.expr(f"rank - (shard * {rows}L + {shards - 1}L) div {shards}L"))
        return scratch.finish(out.select("doc_id", "size", "text_crc32", "curve", "rank", "shard", "slot"))
    w = Window.partitionBy("run").orderBy("at")
    out = out.withColumn("rank", F.col("rows_before") + within)
    out = out.withColumn("mid", F.col("bytes_before") + F.sum("size").over(w) - F.expr("size - size div 2"))
    out = scratch.write(out.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((mid * {shards}L) div {max(total, 1)}L as int)"))), "cut")
    heads = out.groupBy("shard").agg(F.min("rank").alias("head"))
    out = out.join(F.broadcast(heads), "shard").withColumn("slot", F.col("rank") - F.col("head"))
    return scratch.finish(out.select("doc_id", "size", "text_crc32", "curve", "rank", "shard", "slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """The rows themselves, one folder a shard, each file a run of the curve; doc_id must be unique."""
    at = placed.select(F.col("doc_id").alias(id_col), "shard", "slot", "rank")
    out = docs.join(at, id_col).repartitionByRange(shards * files_per_shard, "rank").sortWithinPartitions("rank")
    out.drop("rank").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
