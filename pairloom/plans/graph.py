"""Connected components by alternating star contraction (Kiveris et al., 2014).

Each round is two grouped minima and two equi-joins, so a hub's neighbours are
pre-aggregated before the shuffle and the joins are left to skew splitting. The
minima are written before they are joined: both join sides are then plain
exchanges, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.scratch import Scratch


def _stamp(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _tie_to_least(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with the least of u's closed neighbourhood as ``m``; and the written minima."""
    least = scratch.write(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u"), least


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id on an edge with the smallest id it can reach.

    Null ends and self-loops link nothing; repeated edges count once; no edges, no rows.
    The number of rounds is logarithmic in the longest shortest path.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = scratch.write(both.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    stamp = _stamp(now)
    while stamp[0]:
        ways = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        tied, least = _tie_to_least(ways, scratch)
        large = scratch.write(tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        tied, least2 = _tie_to_least(large, scratch)
        small = tied.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("hi"), F.col("m").alias("lo"))
        small = small.unionAll(least2.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi != lo").distinct()
        after = scratch.write(small, "edges")
        for done in (now, least, large, least2):
            scratch.drop(done)
        was, now, stamp = stamp, after, _stamp(after)
        if stamp == was:
            break
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
