"""Structured Streaming forms of the two jobs that run on and on: scoring of new pairs, and label clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.rules import classify
from pairloom.sources.sinks import append_missing

SCORED = "PATID_A string, PATID_B string, rule_pred string, rule_id string, rule_reason string"
CLICK = "PATID_A string, PATID_B string, gold_label string, ambiguous_pair boolean, reviewed_at timestamp, seq long"


def score_pair_stream(spark: SparkSession, pairs_path: str, records: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Scores pair files as they come. A batch that runs again leaves out the pairs that it has written."""

    def batch(df: DataFrame, _: int) -> None:
        append_missing(classify(df.dropDuplicates(["PATID_A", "PATID_B"]), records), out, SCORED)

    stream = spark.readStream.schema("PATID_A string, PATID_B string").parquet(pairs_path)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def click_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Label clicks with late repeats of one click dropped, within the watermark."""
    return spark.readStream.schema(CLICK).parquet(path).withWatermark("reviewed_at", delay).dropDuplicatesWithinWatermark(["PATID_A", "PATID_B", "seq"])


def clicks_per_window(clicks: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Clicks and touched labels of each window of time."""
    return clicks.groupBy(F.window("reviewed_at", width)).agg(F.count("*").alias("clicks"), F.count("gold_label").alias("labels"))
