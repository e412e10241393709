"""Whole records: columns by position, derived columns, and rows beside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import name_compact_ascii, name_tokens
from pairloom.plans.running import running_totals

#: The phone columns of a record, in the order in which its numbers fill them.
PHONE_SLOTS = ("PrimaryPhoneNBR_clean", "Phone01NBR_clean", "Phone02NBR_clean", "Phone03NBR_clean")
NAME_COLUMNS = ("FirstNM_clean", "MiddleNM_clean", "LastNM_clean")
#: Columns that a record has twice, as it came and cleaned.
MIRRORED = {
    "FirstNM_raw": "FirstNM_clean", "MiddleNM_raw": "MiddleNM_clean", "LastNM_raw": "LastNM_clean", "SuffixNM_raw": "SuffixNM_clean", "BirthDT_raw": "BirthDT_clean", "SSN_raw": "SSN_clean",
    "AddressLine1_raw": "AddressLine1_clean", "AddressLine2_raw": "AddressLine2_clean", "CityNM_raw": "CityNM_clean", "ZipCD_raw": "ZipCD_clean_base", "StateCD_raw": "StateCD_clean",
    "Email_raw": "Email_clean", "SexAtBirthDSC_raw": "SexAtBirthDSC_clean",
}


def renamed(df: DataFrame, names: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns named anew by position, after those of ``drop`` (old names) are gone; a wrong number is an error."""
    kept = df.drop(*drop)
    if len(kept.columns) != len(names):
        raise ValueError(f"{len(kept.columns)} columns for {len(names)} names")
    return kept.toDF(*names)


def _phones(numbers: Column) -> Column:
    """Distinct numbers in order, as one text; null if there is none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(numbers, lambda p: p.isNotNull() & (p != "")))), " "), F.lit(""))


def derived(records: DataFrame) -> DataFrame:
    """Name tokens, compact name and phone set of a record, worked out anew after its columns have changed."""
    return records.withColumns({
        "full_name_tokens": F.nullif(F.array_join(name_tokens(*NAME_COLUMNS), " "), F.lit("")),
        "full_name_compact": name_compact_ascii(*NAME_COLUMNS),
        "Phones_set": _phones(F.split("Phones_set", " ")),
    })


def from_canonical(records: DataFrame, id_col: str, entity_col: str, numbers: Column) -> DataFrame:
    """Full records of clean columns and an array of phone numbers: ids, slots, derived columns, and raw columns that mirror the clean ones."""
    clean = [c for c in MIRRORED.values() if c in records.columns]
    out = records.select(
        F.col(id_col).alias("PATID"), F.col(entity_col).alias("entity_id"), F.lit(True).alias("valid_record"), F.lit("US").alias("CountryNM"),
        *clean, *[F.get(numbers, F.lit(k)).alias(slot) for k, slot in enumerate(PHONE_SLOTS)], _phones(numbers).alias("Phones_set"), F.lit(None).cast("string").alias("Address_normalized"),
    )
    mirrors = {raw: F.col(c) for raw, c in MIRRORED.items() if c in clean} | {s.replace("_clean", "_raw"): F.col(s) for s in PHONE_SLOTS}
    return derived(out).withColumns(mirrors)


def positioned(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """``df`` with its rows' places from 0 in the order of a unique key."""
    out = running_totals(df.withColumn("__one", F.lit(1)), key, {"__one": "__upto"})
    return out.withColumn(name, F.col("__upto") - 1).drop("__one", "__upto")


def aligned(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables that stand at the same place, each table in the order of its own key; what has no counterpart is an error."""
    a, b = positioned(left, left_key), positioned(right, right_key).withColumnRenamed("position", "__position")
    if a.count() != b.count():
        raise ValueError("tables of different length can't be aligned by position")
    return a.join(b, a["position"] == b["__position"]).drop("__position")
