"""From documents to token ids: five stages, each written as Parquet and read again by the next.

1. quality classifier: documents that it rejects go.
2. SimHash near-dedup: of documents linked by a five-word similarity of 0.8 or more one stays, that with the smallest id.
3. substring dedup: words of repeated windows go, and documents of which nothing is left.
4. benchmark decontamination: contaminated documents go.
5. BPE encoding: ids, their number and the digest of what they decode to.

Null, empty and very long texts, repeated rows and empty tables have the results that
the operators' modules state: an empty text is rejected by the first stage, rows of one
id and text become one in the second, an empty table gives no rows throughout. Rows with
a null id are documents like others. What a stage reads besides its input is dropped when
its result is written, and so is all that is left when a stage fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.bpe import encode_whole
from pairloom.llm.decontam import drop_contaminated
from pairloom.llm.nearcopies import keep_one_of_near_copies
from pairloom.llm.quality import drop_rejected
from pairloom.llm.substrings import remove_repeats
from pairloom.plans.scratch import Scratch


#: Bytes of texts in one batch for a Python worker. The JVM and the worker hold some batches
#: of each task at once; Spark's 64 MB of each are a third of an executor of 3 GB.
BATCH = "4m"


def _in_small_batches(spark: SparkSession) -> None:
    """Holds for the session from now on, as a stage is written when it has returned; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def _holding(name: str, spark: SparkSession, make) -> DataFrame:
    """What ``make(scratch)`` gives, with the scratch that it reads; ``run`` drops that when the stage is written."""
    _in_small_batches(spark)
    scratch = Scratch(spark, name)
    try:
        out = make(scratch)
    except BaseException:
        scratch.drop()
        raise
    out._reads = scratch
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _holding("quality", spark, lambda own: drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch=own))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _holding("copies", spark, lambda own: keep_one_of_near_copies(docs, scratch=own))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def make(own: Scratch) -> DataFrame:
        out = remove_repeats(docs, kept_col="__kept", scratch=own)
        out = out.where("n_removed = 0 OR n_removed < n_words").withColumns({"text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")})
        return out.select(*docs.columns)

    return _holding("repeats", spark, make)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _holding("benchmark", spark, lambda own: drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=own))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return encode_whole(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: SQL has no segment-tree BPE, classifier fit or XXH64; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            made = stage(spark, docs, sf_dir)
            try:
                after = scratch.write(made, name.replace(" ", "-"))
            finally:
                if hasattr(made, "_reads"):
                    made._reads.drop()
            if hasattr(docs, "_scratch_path"):
                scratch.drop(docs)
            docs = after
    except BaseException:
        scratch.drop()
        raise
    return docs
