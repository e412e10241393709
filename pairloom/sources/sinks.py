"""Writers: CSV, pair files of a fixed layout, resumable appends, the gold store, and JSON reports."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.labels import KEYS, gold_state
from pairloom.operators.pairs import not_written

#: The model columns of a pair file, in order, and what follows them.
MODEL_COLUMNS = ["FirstNM_clean", "MiddleNM_clean", "LastNM_clean", "SuffixNM_clean", "BirthDT_clean", "SSN_clean", "last_4_SSN", "SexAtBirthDSC_clean", "AddressLine1_clean", "AddressLine2_clean", "CityNM_clean", "StateCD_clean", "ZipCD_clean_base", "Phones_set", "Email_clean"]
PAIR_TAIL = ["label", "case_type", "corruptions_applied", "entity_id_a", "entity_id_b"]
GOLD_SCHEMA = "PATID_A string, PATID_B string, gold_label string, ambiguous_pair boolean, reviewed_at timestamp, seq long"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def pair_layout(df: DataFrame) -> DataFrame:
    """Ids, model columns with left and right side by side, then label and provenance."""
    wanted = ["PATID_A", "PATID_B", *[f"{c}_{s}" for c in MODEL_COLUMNS for s in ("l", "r")], *PAIR_TAIL]
    return df.select(*[c for c in wanted if c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_missing(scored: DataFrame, path: str, schema: str) -> None:
    """Appends the pairs that the table at ``path`` does not have yet: a run that was stopped goes on where it was.

    Work is left out by key, not by a count of lines, so the order of rows does not matter.
    """
    spark = scored.sparkSession
    if exists(spark, path):
        scored = not_written(scored, spark.read.schema(schema).parquet(path))
    scored.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The label log; empty, with its columns, where there is none yet."""
    return spark.read.schema(GOLD_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], GOLD_SCHEMA)


def append_labels(updates: DataFrame, path: str) -> None:
    """Partial updates as new rows; an append is atomic for its readers, and nothing is rewritten."""
    updates.select(*[f.split()[0] for f in GOLD_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Writes a table beside the one at ``path`` and puts it in its place by renames, so a failed write leaves the old one whole.

    A table may be replaced by one that reads it.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    fs = at.getFileSystem(conf)
    df.write.parquet(new.toString())
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"can't put the new table at {path}")
    fs.delete(old, True)
    return spark.read.parquet(path)


def compact_labels(spark: SparkSession, log: str, store: str) -> DataFrame:
    """The newest state of each pair as a table of its own; the log stays as it is."""
    return replace_table(gold_state(read_log(spark, log), KEYS), store)


def write_pools(pools: dict[str, dict], folder: str, spark: SparkSession) -> None:
    """Each pool as one JSON file with sorted keys."""
    for name, pool in pools.items():
        text = json.dumps(pool, sort_keys=True, ensure_ascii=True, indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")


def write_epochs(spark: SparkSession, path: str, epochs: list[dict]) -> None:
    """One row a training round: its number, loss, score and seconds."""
    rows = [(int(e["epoch"]), float(e["loss"]), float(e["score"]), float(e["seconds"])) for e in epochs]
    write_csv(spark.createDataFrame(rows, "epoch int, loss double, score double, seconds double").coalesce(1), path, "overwrite")


def save_model(model, path: str) -> None:
    """A fitted pipeline in a folder that every executor can read; ``load_model`` gives it back."""
    model.write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path)


def write_report(path: str, parts: dict[str, DataFrame]) -> None:
    """Small tables as one JSON file, written by Spark so that the path may be in any store."""
    from pairloom.operators.profile import stats_document

    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(stats_document(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def html_cards(pairs: DataFrame, fields: list[str], limit: int = 20) -> str:
    """Cards of some pairs for reading; values are escaped."""
    import html

    from pairloom.operators.labels import payload

    rows = pairs.orderBy("PATID_A", "PATID_B").limit(limit).select("PATID_A", "PATID_B", payload(fields).alias("p")).collect()
    cells = lambda items: "".join(f'<tr class="{i["cls"]}"><th>{html.escape(i["name"])}</th><td>{html.escape(i["a"])}</td><td>{html.escape(i["b"])}</td></tr>' for i in items)
    return "".join(f"<h3>{html.escape(str(r['PATID_A']))} / {html.escape(str(r['PATID_B']))}</h3><table>{cells(json.loads(r['p']))}</table>" for r in rows)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c) for c in order]).limit(n)
