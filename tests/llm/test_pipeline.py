"""The pipeline's stages on their own inputs, against plain versions of what each must do."""

import itertools
import os
import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from pairloom.llm.queries import oracle_sql, queries
from pairloom.plans.scratch import checkpoint_dir
from tests.llm.test_near_copies import words
from tests.llm.test_operators import SF, docs_of, plain_removed, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding"]
    for k, (name, stage) in enumerate(P.STAGES):
        after = stage(spark, docs, SF).cache()
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        ids = {r["doc_id"] for r in after.collect()}
        assert ids <= set(before)
        if k < 4:
            assert after.columns == COLUMNS
        if k == 1:
            sets = [(i, words(t)) for i, t in before.items()]
            pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 10 * len(x & y) >= 8 * len(x | y)]
            assert ids == set(roots(pairs, set(before)).values())
        if k == 2:
            want = {i: (n, gone) for i, n, gone, _ in plain_removed(list(before.items()), 20)}
            assert ids == {i for i in before if want[str(i)][1] == 0 or want[str(i)][1] < want[str(i)][0]}
            for r in after.collect():
                n, gone = want[str(r["doc_id"])]
                assert r["text"] == before[r["doc_id"]] if not gone else len(r["text"].split()) == n - gone
        if k == 4:
            assert after.where(F.size("ids") != F.col("n_tokens")).count() == 0
        docs = after


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, SF).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_only_its_result(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    P.run(spark, SF).count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")} == {"pipeline"}


def test_stages_with_odd_rows(spark):
    """Null ids, null, empty and blank texts, repeated rows, repeated ids, and a long text go through every stage."""
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(["the", "river", "house", "small", "walked", "over", "stone", "light", f"word{r.randrange(900)}"]) for _ in range(n)) + "."
    a, b, long = prose(120), prose(90), prose(200_000)
    texts = [(1, a), (1, a), (2, a), (3, b), (3, prose(80)), (None, b), (None, prose(70)), (None, prose(70)), (4, None), (None, None), (5, ""), (6, " \t"), (7, long), (8, long + " end"), (9, "one")]
    docs = docs_of(spark, texts)
    for k, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, docs, SF)
        assert after.columns == COLUMNS if k < 4 else "ids" in after.columns
        rows = after.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if k == 1:
            kept = [(x["doc_id"], x["text"]) for x in rows]
            assert len(kept) == len(set(kept)) and (1, a) in kept and (2, a) not in kept and (None, b) not in kept and (8, long + " end") not in kept
        if k < 4:
            docs = spark.createDataFrame(rows, docs.schema)


def test_registered():
    assert {q.split("_")[0] for q in queries()} == {"pipeline", *(f"op{n}" for n in range(1, 11))}
    assert set(oracle_sql()) <= set(queries())


def test_words_are_hashed_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from pairloom.llm import words as W

    text = pa.array([" ".join(f"w{k}" for k in range(500_000)), "x" * (3 * W.BLOCK) + " y"])
    W._powers.cache_clear()
    tracemalloc.start()
    got = W.words(text, W.WHITE)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * text.nbytes
    alone = [W.words(pa.array([w]), W.WHITE).hash[0] for w in ("w0", "w77777", "w499999", "x" * (3 * W.BLOCK), "y")]
    assert np.array_equal(got.hash[[0, 77_777, 499_999, 500_000, 500_001]], np.array(alone))


def test_stages_send_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('a b ', 250000) AS text", "'en' AS lang", "'s' AS source", "1000000L AS n_chars")
    try:
        P.encoding(spark, docs, str(tmp_path))

        def sizes(batches):
            for b in batches:
                yield type(b).from_pydict({"size": [b.nbytes]})

        assert max(r[0] for r in docs.select("text").mapInArrow(sizes, "size long").collect()) <= 8 << 20
    finally:
        spark.conf.set(name, held)
