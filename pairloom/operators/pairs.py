"""Blocking and the joins that make, attach, filter and align pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.plans.running import running_totals


def block_pairs(records: DataFrame, keys: list[str], id_col: str = "PATID", carry: list[str] | None = None, tile_rows: int = 4096) -> DataFrame:
    """PATID_A < PATID_B of records that share all keys (none of them null), with <carry>_a and <carry>_b.

    Both sides are dealt once, by the keys and a tile: a block of more than ``tile_rows``
    records is cut into tiles by id, and each tile of one side meets the whole other side.
    So a large block is made by many tasks, and no block is capped.
    """
    carry = carry or []
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = records.dropna(subset=keys)
    large = known.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > tile_rows)
    large = large.select(*keys, F.ceil(F.col("__n") / tile_rows).cast("int").alias("__tiles"))
    known = known.select(*keys, F.col(id_col).alias("__id"), *carry).join(large, keys, "left")
    tiles = F.coalesce("__tiles", F.lit(1))
    own = known.withColumn("__tile", F.pmod(F.xxhash64("__id"), tiles).cast("int"))
    every = known.withColumn("__tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    side = lambda df, s: df.select(*keys, "__tile", F.col("__id").alias(f"PATID_{s.upper()}"), *[F.col(c).alias(f"{c}_{s}") for c in carry]).repartition(n, *keys, "__tile")
    # a join that needs just this dealing: broadcasting a small side would leave the many pairs to few tasks
    return side(own, "a").join(side(every, "b").hint("shuffle_hash"), [*keys, "__tile"]).where("PATID_A < PATID_B").drop(*keys, "__tile")


def block_wide(records: DataFrame, keys: list[str], fields: list[str], sides: tuple[str, str] = ("a", "b"), id_col: str = "PATID", carry: list[str] | None = None) -> DataFrame:
    """``block_pairs`` with both records' fields: what ``attach`` gives for them where ids are unique, but records are moved once and pairs never."""
    carry = carry or []
    out = block_pairs(records.select(id_col, *keys, *carry, *[F.col(f).alias(f"__{f}") for f in fields]), keys, id_col, [*carry, *[f"__{f}" for f in fields]])
    return out.select("PATID_A", "PATID_B", *[f"{c}_{x}" for c in carry for x in "ab"], *[F.col(f"__{f}_{x}").alias(f"{f}_{s}") for x, s in zip("ab", sides) for f in fields])


def pairs_of_first(records: DataFrame, keys: list[str], upto: str, id_col: str = "PATID", carry: list[str] | None = None) -> DataFrame:
    """``block_pairs`` whose first record's id is at most ``upto``: those records are broadcast, so they must be few; the others are not moved."""
    carry = carry or []
    known = records.dropna(subset=[id_col, *keys])
    side = lambda df, s: df.select(*keys, F.col(id_col).alias(f"PATID_{s.upper()}"), *[F.col(c).alias(f"{c}_{s}") for c in carry])
    first = side(known.where(F.col(id_col) <= upto), "a")
    return F.broadcast(first).join(side(known, "b"), keys).where("PATID_A < PATID_B").drop(*keys)


def block_sizes(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records and pairs of each block, to see skew before pairs are made."""
    return records.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("records")).withColumn("pairs", F.expr("records * (records - 1) div 2"))


def block_budget(records: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Blocks with their records and pairs, smallest first, and whether each is within a budget of ``most`` pairs in all.

    Nothing is dropped without a row that says so: pairs are then made of the blocks that
    are ``kept``, and the others' rows report what was not.
    """
    sizes = block_sizes(records, keys)
    sizes = sizes.withColumn("key", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    sizes = sizes.withColumn("rank", F.concat(F.lpad(F.col("pairs").cast("string"), 20, "0"), F.lit("|"), "key"))
    out = running_totals(sizes, "rank", {"pairs": "pairs_so_far"})
    return out.select(*keys, "records", "pairs", "pairs_so_far", (F.col("pairs_so_far") <= most).alias("kept"))


def add_side(records: DataFrame, side: str, fields: list[str], id_col: str = "PATID") -> DataFrame:
    """PATID_<side> with <field>_<side> columns."""
    return records.select(F.col(id_col).alias(f"PATID_{side.upper()}"), *[F.col(f).alias(f"{f}_{side}") for f in fields])


def attach(pairs: DataFrame, records: DataFrame, fields: list[str], sides: tuple[str, str] = ("a", "b"), how: str = "inner", id_col: str = "PATID") -> DataFrame:
    """Both records' fields on each pair; inner drops unknown ids, left makes them null."""
    a, b = sides
    left = add_side(records, a, fields, id_col).withColumnRenamed(f"PATID_{a.upper()}", "PATID_A")
    right = add_side(records, b, fields, id_col).withColumnRenamed(f"PATID_{b.upper()}", "PATID_B")
    return pairs.join(left, "PATID_A", how).join(right, "PATID_B", how)


def check_unique(records: DataFrame, id_col: str = "PATID") -> None:
    twice = records.groupBy(id_col).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{id_col} is not unique: {[r[0] for r in twice]}")


def check_all_known(pairs: DataFrame, records: DataFrame, id_col: str = "PATID") -> None:
    """Raises for a pair whose record is missing, as an index lookup would."""
    ids = pairs.select(F.col("PATID_A").alias(id_col)).union(pairs.select("PATID_B"))
    missing = ids.join(records.select(id_col), id_col, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown {id_col}: {[r[0] for r in missing]}")


def valid_records(records: DataFrame) -> DataFrame:
    """Records that are valid; pairs made of them need no further check."""
    if "valid_record" not in records.columns:
        raise ValueError("records have no valid_record column")
    return records.where("valid_record")


def valid_pairs(pairs: DataFrame, records: DataFrame, id_col: str = "PATID") -> DataFrame:
    """Given pairs of which both records are valid: two semi-joins."""
    good = valid_records(records).select(id_col)
    out = pairs
    for c in ("PATID_A", "PATID_B"):
        out = out.join(good.withColumnRenamed(id_col, c), c, "left_semi")
    return out.select(*pairs.columns)


def has_any(fields: list[str]) -> Column:
    """Some field is present."""
    return reduce(lambda x, y: x | y, [F.col(f).isNotNull() for f in fields])


def joinable(fields: list[str], sides: tuple[str, str] = ("a", "b")) -> Column:
    """Some field is present on each side."""
    return has_any([f"{f}_{sides[0]}" for f in fields]) & has_any([f"{f}_{sides[1]}" for f in fields])


def bridge(left: DataFrame, right: DataFrame, ids: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two tables joined through pairs of their ids, columns named _l and _r, without the keys."""
    a = left.select(F.col(left_key).alias("ltable_id"), *[F.col(c).alias(f"{c}_l") for c in left.columns if c != left_key])
    b = right.select(F.col(right_key).alias("rtable_id"), *[F.col(c).alias(f"{c}_r") for c in right.columns if c != right_key])
    return ids.join(a, "ltable_id").join(b, "rtable_id").drop("ltable_id", "rtable_id")


def not_written(pairs: DataFrame, written: DataFrame, keys: tuple[str, ...] = ("PATID_A", "PATID_B")) -> DataFrame:
    """Pairs that a former run has not written: what a resumed run has left to do."""
    return pairs.join(written.select(*keys), list(keys), "left_anti")


def first_marked(records: DataFrame, done: DataFrame, name: str, id_col: str = "PATID") -> DataFrame:
    """Records with ``name``: whether their id stands in ``done``, for runs that work off whole first records.

    Such a run has written or scored all pairs of a first record or none, so what is left
    of it is told by records. Carried by ``block_pairs``, the mark spares ``not_written``
    and ``with_predictions`` their join of two tables of pairs.
    """
    marks = done.select(id_col).distinct().withColumn(name, F.lit(True))
    return records.join(marks, id_col, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def present_in_both(pairs: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("PATID_A", "PATID_B")) -> DataFrame:
    return pairs.join(others.select(*keys), list(keys), "left_semi")


def inner_with_dropped(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("PATID_A", "PATID_B")) -> tuple[DataFrame, DataFrame]:
    """The inner join, and one row of counts: joined, and dropped from each side. One full join gives all three."""
    out = left.join(right, list(keys))
    marks = left.select(*keys, F.lit(1).alias("l")).join(right.select(*keys, F.lit(1).alias("r")), list(keys), "full_outer")
    counts = marks.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("joined"), F.count_if(F.col("r").isNull()).alias("left_dropped"), F.count_if(F.col("l").isNull()).alias("right_dropped"))
    return out, counts


def with_predictions(pairs: DataFrame, scored: DataFrame, keys: tuple[str, ...] = ("PATID_A", "PATID_B")) -> tuple[DataFrame, DataFrame]:
    """Pairs with their predictions, null where there is none, and one row that says how many are missing."""
    out = pairs.join(scored.withColumn("__found", F.lit(True)), list(keys), "left")
    report = out.agg(F.count("*").alias("pairs"), F.count_if(F.col("__found").isNull()).alias("missing"))
    return out.drop("__found"), report


def within_groups(records: DataFrame, keys: list[str], fields: list[str], id_col: str = "PATID") -> DataFrame:
    """All pairs of a group with both sides' fields."""
    return block_pairs(records, keys, id_col, fields)


def aligned_counts(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Counts of a value on both sides, 0 where it is absent."""
    a = left.groupBy(value).agg(F.count("*").alias("n_left"))
    b = right.groupBy(value).agg(F.count("*").alias("n_right"))
    return a.join(b, value, "full_outer").na.fill(0, ["n_left", "n_right"])


def cross_name_match(sides: tuple[str, str] = ("a", "b"), fields: tuple[str, ...] = ("first_name", "middle_name", "last_name")) -> Column:
    """A name field of one side equals some name field of the other, as a whole."""
    from pairloom.functions.text import prediction_norm

    one = lambda s: F.array_compact(F.array(*[prediction_norm(f"{f}_{s}") for f in fields]))
    return F.arrays_overlap(one(sides[0]), one(sides[1]))


def match_degree(edges: DataFrame, a: str = "PATID_A", b: str = "PATID_B") -> DataFrame:
    """Number of matches of each record."""
    return edges.select(F.col(a).alias("PATID")).unionAll(edges.select(F.col(b))).groupBy("PATID").agg(F.count("*").alias("degree"))
