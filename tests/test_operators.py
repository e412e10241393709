"""Operators without SQL of their own: sources, sinks, streams, generator invariants, components, running totals."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import generate as G
from pairloom.operators import labels as L
from pairloom.operators import metrics as M
from pairloom.operators import qa
from pairloom.operators import sampling as S
from pairloom.operators import score
from pairloom.operators import serialize as Z
from pairloom.operators.pairs import block_wide, check_all_known, check_unique
from pairloom.operators.schema import FEATURES, prepare_pairs, prepare_records
from pairloom.plans.graph import connected_components
from pairloom.plans.running import running_totals
from pairloom.plans.scratch import Scratch
from pairloom.sources import sinks, tables
from pairloom.streaming import jobs


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "t.csv").write_text('PATID,SSN_clean_l,name_l\n1,007,NA\n2,,"a, b"\n')
    read = lambda m: [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv"), m).orderBy("PATID").collect()]
    assert read("default") == [("1", "007", None), ("2", None, "a, b")]
    assert read("empty") == [("1", "007", "NA"), ("2", None, "a, b")]
    assert read("none") == [("1", "007", "NA"), ("2", "", "a, b")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t.csv"), "some")


def test_records_and_pairs(spark, tmp_path):
    spark.createDataFrame([(1, True, "JO", "{'3125550100', '2245550100'}", "1/5/1980"), (2, False, "X", None, None)], "PATID long, valid_record boolean, FirstNM_clean string, Phones_set string, BirthDT_clean string").write.parquet(str(tmp_path / "r"))
    r = tables.read_records(spark, str(tmp_path / "r"))
    assert [tuple(x) for x in r.select("PATID", "first_name", "phone", "dob").collect()] == [("1", "JO", "2245550100 3125550100", "1980-01-05")]
    p = prepare_pairs(spark.createDataFrame([("A", "x", "y")], "FirstNM_clean_l string, other_l string, keep string"))
    assert p.columns == ["keep", *[f"{f}_{s}" for s in ("l", "r") for f in FEATURES]]
    assert prepare_records(spark.createDataFrame([("A", 1)], "FirstNM_clean string, z int")).columns == ["first_name", "z"]
    with pytest.raises(ValueError):
        check_unique(spark.createDataFrame([("a",), ("a",)], "PATID string"))
    with pytest.raises(KeyError):
        check_all_known(spark.createDataFrame([("a", "b")], "PATID_A string, PATID_B string"), spark.createDataFrame([("a",)], "PATID string"))


def test_resume_twice_is_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), str(i + 1), i) for i in range(20)], "PATID_A string, PATID_B string, v int")
    out = str(tmp_path / "out")
    for part in (rows.where("v < 7"), rows, rows):
        sinks.append_missing(part, out, "PATID_A string, PATID_B string, v int")
    assert spark.read.parquet(out).count() == 20


def test_gold_store(spark, tmp_path):
    log, schema = str(tmp_path / "log"), sinks.GOLD_SCHEMA
    assert sinks.read_log(spark, log).count() == 0
    t = "2024-01-01 00:00:0"
    clicks = [("a", "b", "match", None, f"{t}1", 1), ("a", "b", None, True, f"{t}2", 2), ("c", "d", "match", None, f"{t}1", 3), ("c", "d", L.CLEAR, None, f"{t}3", 4)]
    df = spark.createDataFrame(clicks, schema.replace("timestamp", "string")).withColumn("reviewed_at", F.to_timestamp("reviewed_at"))
    sinks.append_labels(df, log)
    state = {r["PATID_A"]: (r["gold_label"], r["ambiguous_pair"]) for r in sinks.compact_labels(spark, log, str(tmp_path / "store")).collect()}
    assert state == {"a": ("match", True), "c": (None, False)}


def test_streams(spark, tmp_path):
    records = G.records_of(G.matches(spark, 30, 3)).select("PATID", *FEATURES)
    pairs = G.matches(spark, 30, 3).select("PATID_A", "PATID_B")
    pairs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.score_pair_stream(spark, str(tmp_path / "in"), records, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    log = spark.createDataFrame([("a", "b", "match", None, "2024-01-01 00:00:01", 1)] * 3, sinks.GOLD_SCHEMA.replace("timestamp", "string")).withColumn("reviewed_at", F.to_timestamp("reviewed_at"))
    log.write.parquet(str(tmp_path / "clicks"))
    q = jobs.click_stream(spark, str(tmp_path / "clicks")).writeStream.format("memory").queryName("clicks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("clicks").count() == 1


def test_generated_corpus(spark):
    train, test = G.build_train(spark, 1500), G.build_test(spark, 800)
    qa.require_hard(qa.run_checks(train, test))
    assert train.select("PATID_A", "PATID_B").distinct().count() == 1500
    again = G.build_train(spark.newSession(), 1500).repartition(7)
    assert again.exceptAll(train).count() == 0  # the corpus does not depend on the partitioning
    made = {r[0] for r in G.matches(spark, 2500, 5, cases=list(G.MATCHES)).select("case_type").distinct().collect()}
    assert made == set(G.MATCHES)
    assert sinks.pair_layout(G.technical(train)).columns[:4] == ["PATID_A", "PATID_B", "FirstNM_clean_l", "FirstNM_clean_r"]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: top(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_running_totals(spark):
    got = running_totals(spark.range(100).selectExpr("id AS k", "id AS v"), "k", {"v": "s"}, ranges=5).orderBy("k").collect()
    assert [r["s"] for r in got] == [k * (k + 1) // 2 for k in range(100)]


def test_samplers_and_scorers(spark):
    assert S.sampler("automl_filter") is S.automl_filter
    with pytest.raises(ValueError):
        S.sampler("os.system")
    with pytest.raises(ValueError):
        Z.serialized(["a_l", "a_r"], "mode9")
    df = spark.range(30).selectExpr("id AS k", "repeat('x', cast(id as int)) AS text")
    out = score.score_with(df, lambda: lambda texts: [(len(t) % 2, None) for t in texts], batch=4)
    assert {(r["k"], r["pred"]) for r in out.collect()} == {(k, k % 2) for k in range(30)}
    stop = score.EarlyStop(2, 3)
    assert [stop.better(x) for x in (0.1, 0.1, 0.1)] == [True, False, False] and not stop.stop
    stop.better(0.0)
    assert stop.stop
    assert tables.leave_one_out(["a", "b"], "a") == ["b"]


def test_html_cards_are_escaped(spark):
    df = spark.createDataFrame([("1", "2", "<b>", "x")], "PATID_A string, PATID_B string, n_a string, n_b string")
    assert "&lt;b&gt;" in sinks.html_cards(df, ["n"])


@pytest.mark.parametrize("probe, few", [(1 / 4096, 30), (1 / 4, 30), (1 / 4, 0), (1 / 4, 900)])
def test_attributes_downsampled_without_moving_large_classes(spark, monkeypatch, probe, few):
    """Repeated rows count once; of a class that is far larger than the rarest only the first drawn rows are written."""
    import hashlib

    from pairloom.operators import sampling
    from pairloom.plans.scratch import Scratch

    monkeypatch.setattr(sampling, "PROBE", probe)
    wrote, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name="t": [out := real(self, df, name), wrote.append(out.count()) if name == "rows" else None][0])
    rows = [(f"v{k}", None if k % 9 == 0 else f"w{k % 7}", 0, "x") for k in range(6000)] + [(f"p{k}", "q", 1, "x") for k in range(few)] + [("s", "t", k % 2, "y") for k in range(2)]
    df = spark.createDataFrame(rows + rows[:500], "left_value string, right_value string, label int, attribute string")
    got = sorted(map(str, map(tuple, sampling.downsample_attributes(df, "left_value", "right_value", "label", most=40).collect())))
    md5 = lambda seed, r: hashlib.md5(":".join(str(v) for v in (seed, *r[:3]) if v is not None).encode()).hexdigest()
    want = []
    for a in "xy":
        classes = [c for c in ([r for r in rows if r[3] == a and r[2] == y] for y in (0, 1)) if c]
        even = [r for c in classes for r in sorted(c, key=lambda r: md5(42, r))[: min(map(len, classes))]]
        want += sorted(even, key=lambda r: md5(43, r))[:40]
    assert got == sorted(map(str, want))
    if probe == 1 / 4 and few == 30:
        assert len(wrote) == 1 and wrote[0] < 1500


def test_lengths_of_pairs_without_pairs(spark):
    rng = random.Random(3)
    fields = ["x", "y"]
    rows = [(f"P{k}" if k % 23 else None, rng.choice([1, 2, None]), rng.choice([None, "", "\u00e9", "ab", "N/A", "long" * 9]), "z" * rng.randrange(40)) for k in range(150)]
    records = spark.createDataFrame(rows, "PATID string, b int, x string, y string")
    columns = [f"{f}_l" for f in fields] + [f"{f}_r" for f in fields]
    twice = records.select("PATID", "b", *[F.col(f).alias(f"{f}_{s}") for s in "lr" for f in fields])
    for mode in ("mode1", "mode4"):
        texts = block_wide(records, ["b"], fields, ("l", "r")).select(Z.serialized(columns, mode).alias("text"))
        for most in (0, 130, 150, 170, 999):
            want = score.within_length(texts, F.length("text"), most)[1].first()
            assert tuple(score.pairs_within_length(twice, ["b"], F.length(Z.serialized(columns, mode)), most).first()) == tuple(want)
    assert tuple(score.pairs_within_length(twice.limit(0), ["b"], F.length("x_l"), 9).first()) == (0, 0)
    from pairloom.queries import registry

    plan = registry.queries()["token_lengths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__tile" not in plan  # of pairs that are made


@pytest.mark.parametrize("first", [1, 20, 500])
def test_nearest_pairs_are_those_of_all_pairs(spark, first):
    rng = random.Random(first)
    rows = [(f"P{k}" if k % 31 else None, rng.choice([1, 2, None]), rng.randrange(40)) for k in range(200)]
    records = spark.createDataFrame(rows, "PATID string, b int, v int")
    scored = lambda pairs: pairs.withColumn("score", (F.col("v_a") + F.col("v_b")) / 100.0)
    every = [((r[2] + s[2]) / 100.0, r[0], s[0]) for r in rows for s in rows if r[0] and s[0] and r[0] < s[0] and r[1] == s[1] is not None]
    for t, k in ((0.4, 7), (0.405, 7), (0.78, 30), (0.4, 10**6)):
        want = sorted((abs(x - t), a, b) for x, a, b in every)[:k]
        got = M.nearest_pairs(records, ["b"], ["v"], scored, "score", t, k, first=first).collect()
        assert sorted((abs(r["score"] - t), r["PATID_A"], r["PATID_B"]) for r in got) == want
    assert M.nearest_pairs(records.limit(0), ["b"], ["v"], scored, "score", 0.4, 3).collect() == []


def test_nearest_pairs_make_few_pairs(spark):
    from pairloom.queries import registry

    plan = registry.queries()["uncertain_topk"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "__tile" not in plan  # of pairs that are made
