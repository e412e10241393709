"""Population profile: aggregates that name no value with fewer than k records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.dates import decade, dob_relation, parse_date
from pairloom.functions.text import is_po_box
from pairloom.operators.aggregates import percentiles, side_by_side
from pairloom.operators.pairs import block_pairs

TAIL = "__OTHER__"


def top_values(df: DataFrame, value: Column, k: int = 20, top: int = 25, by: list[str] | None = None) -> DataFrame:
    """The most common values with at least k records, and a last row for all others, values beyond ``top`` included."""
    by = by or []
    counts = df.where(value.isNotNull()).groupBy(*by, value.cast("string").alias("value")).agg(F.count("*").alias("n"))
    safe = counts.where(F.col("n") >= k)
    if by:
        head = safe.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))).where(F.col("r") <= top).drop("r")
        tail = counts.groupBy(*by).agg(F.sum("n").alias("t")).join(head.groupBy(*by).agg(F.sum("n").alias("h")), by, "left")
    else:
        head = safe.orderBy(F.desc("n"), "value").limit(top)
        tail = counts.agg(F.sum("n").alias("t")).join(head.agg(F.sum("n").alias("h")))
    tail = tail.select(*by, F.lit(TAIL).alias("value"), (F.coalesce("t", F.lit(0)) - F.coalesce("h", F.lit(0))).alias("n"))
    return head.unionByName(tail.where("n > 0"))


def length_profile(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    by = by or []
    lengths = df.where(value.isNotNull()).select(*by, F.length(value).cast("double").alias("length"))
    out = lengths.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.stddev_pop("length"), 6).alias("std"))
    q = percentiles(lengths, by, "length", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return side_by_side(out, q, by).select(*by, "n", "mean", "std", *[F.col(c).cast("int").alias(c) for c in ("p5", "p50", "p95")])


def token_profile(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    t = F.size(F.filter(F.split(value, r"\s+"), lambda x: x != ""))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.where(value.isNotNull()).groupBy(*(by or [])).agg(F.round(F.avg(t), 6).alias("mean_tokens"), share(t == 1).alias("one"), share(t == 2).alias("two"), share(t >= 3).alias("three_up"), share(value.contains("-")).alias("hyphen"), share(value.contains("'")).alias("apostrophe"))


def missingness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Records and missing values of each field, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])
    return one.select("n", F.explode(rows).alias("r")).select("r.field", "n", "r.missing", F.round(F.col("r.missing") / F.col("n"), 6).alias("rate"))


def co_missing(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Share of records that miss all fields of a group."""
    none = lambda fs: F.coalesce(*[F.col(f) for f in fs]).isNull()
    one = df.agg(*[F.round(F.avg(none(fs).cast("double")), 6).alias(g) for g, fs in groups.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("fields"), F.col(g).alias("rate")) for g in groups])).alias("r")).select("r.*")


def missing_patterns(df: DataFrame, fields: list[str], k: int = 20, top: int = 50) -> DataFrame:
    """Bit texts of presence, one character a field."""
    bits = F.concat(*[F.when(F.col(f).isNotNull(), "1").otherwise("0") for f in fields])
    return top_values(df, bits, k, top)


def items_per_record(df: DataFrame, value: Column) -> DataFrame:
    n = F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.split(value, r"\s+"), lambda x: x != "")))
    return df.groupBy(n.alias("items")).agg(F.count("*").alias("n"))


def date_profile(df: DataFrame, day: Column) -> DataFrame:
    """Counts by decade, month and day in one pass of grouping sets' worth of rows: part, value, n."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), v.cast("int").alias("value")) for p, v in (("decade", decade(day)), ("month", F.month(day)), ("day", F.dayofmonth(day)))])
    return df.where(day.isNotNull()).select(F.explode(parts).alias("r")).groupBy("r.part", "r.value").agg(F.count("*").alias("n"))


def date_range(df: DataFrame, day: Column, year: int = 2000) -> DataFrame:
    return df.where(day.isNotNull()).agg(F.min(F.year(day)).alias("min_year"), F.max(F.year(day)).alias("max_year"), F.round(F.avg((F.year(day) >= year).cast("double")), 6).alias("recent"))


def contact_profile(df: DataFrame, k: int = 20, top: int = 25) -> DataFrame:
    """Area codes, email domains, last word of the address and unit words, each k-anonymous: kind, value, n."""
    kinds = {
        "area_code": F.substring("phone", 1, 3),
        "email_domain": F.when(F.col("email").contains("@"), F.element_at(F.split("email", "@"), -1)),
        "street_suffix": F.element_at(F.split("address", " "), -1),
        "unit": F.split_part(F.col("address2"), F.lit(" "), F.lit(1)),
        "ssn_area": F.substring("ssn", 1, 3),
    }
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("v")) for n, c in kinds.items()])).alias("r")).select("r.*")
    return top_values(long, F.col("v"), k, top, ["kind"])


def po_box_share(df: DataFrame, address: str = "address") -> DataFrame:
    """How many addresses there are, and the share of them that are PO boxes."""
    return df.where(F.col(address).isNotNull()).agg(F.count("*").alias("addresses"), F.round(F.avg(is_po_box(address).cast("double")), 6).alias("po_box_share"))


def mode_agreement(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of records whose value is the most common one of their key; the smallest of equally common ones."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("all"), F.max("n").alias("top"))
    return best.agg(F.count("*").alias("keys"), F.sum("all").alias("n"), F.round(F.sum("top") / F.sum("all"), 6).alias("agreement"))


def joint_top(df: DataFrame, cols: list[str], k: int = 20, top: int = 25) -> DataFrame:
    whole = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 0, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    return top_values(df, whole, k, top)


def within_cluster_agreement(df: DataFrame, keys: list[str], id_col: str = "PATID") -> DataFrame:
    """Over all pairs of a cluster: how often two records agree, differ by one or two edits, or share a kind of date relation."""
    fields = ["first_name", "middle_name", "last_name", "dob", "zip", "phone", "email", "sex", "address"]
    p = block_pairs(df, keys, id_col, fields)
    both = lambda f: F.col(f"{f}_a").isNotNull() & F.col(f"{f}_b").isNotNull()
    eq = lambda f: F.col(f"{f}_a") == F.col(f"{f}_b")
    lev = lambda f: F.levenshtein(f"{f}_a", f"{f}_b")
    rel = dob_relation(parse_date("dob_a"), parse_date("dob_b"))
    metrics: dict[str, tuple[Column, Column]] = {f"{f}_equal": (both(f), eq(f)) for f in fields}
    metrics |= {f"{f}_within{n}": (both(f), lev(f) <= n) for f in ("first_name", "last_name") for n in (1, 2)}
    metrics |= {f"dob_{r}": (rel.isNotNull(), rel == r) for r in ("exact", "transpose", "off_day", "off_year", "other")}
    metrics |= {"middle_one_missing": (F.lit(True), F.col("middle_name_a").isNull() != F.col("middle_name_b").isNull())}
    one = p.agg(*[x for m, (base, hit) in metrics.items() for x in (F.count_if(base).alias(f"d_{m}"), F.count_if(base & hit).alias(f"n_{m}"))])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("numerator"), F.col(f"d_{m}").alias("denominator")) for m in metrics]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*", F.round(F.when(F.col("r.denominator") > 0, F.col("r.numerator") / F.col("r.denominator")), 6).alias("rate"))


def stats_document(parts: dict[str, DataFrame]) -> str:
    """Small report tables as one JSON document; every part is an aggregate of bounded size."""
    return json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in parts.items()}, default=str, sort_keys=True)
