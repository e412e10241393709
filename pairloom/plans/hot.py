"""A join by a key that a third of all rows may share.

The facts of a key come with how many rows have it. Keys with over one in ``share`` of
all rows are fewer than ``share`` by number, so their facts are broadcast; the other
facts are joined by the key, and no task gets more than its part. Rows with a hot or
null key go to that join under numbers of their own, so they are spread too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_with_hot_keys(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, share: int = 4096) -> DataFrame:
    """``rows`` with the other columns of ``facts`` (one row a key; ``n`` counts the rows that have it), null where none."""
    more = [c for c in facts.columns if c not in (key, n)]
    most = total // share
    hot = facts.where(F.col(n) > most).select(key, *[F.col(c).alias(f"__hot_{c}") for c in more], F.lit(True).alias("__is_hot"))
    cold = facts.where(F.col(n) <= most).select(F.col(key).alias("__key"), F.lit(-1).cast("long").alias("__row"), *[F.col(c).alias(f"__cold_{c}") for c in more])
    out = rows.join(F.broadcast(hot), key, "left")
    alone = F.col("__is_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumns({"__key": F.when(~alone, F.col(key)), "__row": F.when(alone, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))})
    out = out.join(cold, ["__key", "__row"], "left")
    return out.select(*rows.columns, *[F.when(F.col("__is_hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in more])
