"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing: a lost executor costs a re-read, not a recomputation.
The folder is the one the cluster names in ``spark.checkpoint.dir``; a local one
is made only where that is unset and Spark runs in a single process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named:
        if held.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pairloom-')}")
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """A run's own folder of written tables; ``finish`` keeps the result and drops the rest."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        at = self.path if df is None else df._scratch_path
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        out = df.checkpoint()
        self.drop()
        return out
