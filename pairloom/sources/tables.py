"""Readers: text tables without type inference, record and pair tables, vocabularies, and several folders as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import SENTINELS
from pairloom.operators.schema import cast_ids, prepare_pairs, prepare_records, require, text_schema

#: Texts that a default CSV reader takes for missing.
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(spark: SparkSession, path: str, missing: str = "default") -> DataFrame:
    """All columns as text. missing: "default" (the usual texts are null), "empty" (only '' is), "none" (nothing is)."""
    if missing not in ("default", "empty", "none"):
        raise ValueError(f"missing must be default, empty or none, not {missing!r}")
    df = spark.read.schema(text_schema(_header(spark, path))).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    if missing == "none":
        return df.na.fill("")
    null = DEFAULT_NA if missing == "default" else ("",)
    return df.select(*[F.when(F.col(f"`{c}`").isin(*null), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file of wide pairs with canonical fields of both sides."""
    return prepare_pairs(read_csv(spark, path))


def read_records(spark: SparkSession, path: str, valid_only: bool = True) -> DataFrame:
    """Records with canonical fields; ids as text; only valid ones, which the column must say."""
    df = cast_ids(spark.read.parquet(path))
    require(df, ["PATID", *(["valid_record"] if valid_only else [])])
    return prepare_records(df.where("valid_record") if valid_only else df)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("PATID_A").cast("string"), F.col("PATID_B").cast("string"))


def read_many(spark: SparkSession, paths: list[str], reader=read_csv) -> DataFrame:
    """Several tables of one schema as one."""
    return reduce(DataFrame.unionByName, [reader(spark, p) for p in paths])


def read_vocabulary(spark: SparkSession, path: str) -> dict:
    """A JSON file of weighted, flat and mapped lists; a vocabulary is small by its nature."""
    import json

    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def from_pickle(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A compressed pandas pickle, read once on the driver to be written as Parquet; only from a source that is trusted."""
    import pandas as pd

    return spark.createDataFrame(pd.read_pickle(path)[columns])


def leave_one_out(datasets: list[str], held_out: str) -> list[str]:
    if held_out not in datasets:
        raise ValueError(f"no data set {held_out!r}")
    return [d for d in datasets if d != held_out]


def is_missing_text(value: str | None) -> bool:
    return value is None or value.strip().lower() in SENTINELS
