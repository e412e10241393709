"""Records, positions, percentiles, token ids and generator parts against plain versions."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.functions.similarity import near_tokens
from pairloom.operators import aggregates, generate, pairs, qa, records, rules, sampling, score
from pairloom.operators.schema import FEATURES
from pairloom.plans.scratch import checkpoint_dir
from pairloom.sources import sinks


@pytest.fixture(autouse=True, scope="module")
def folder(spark):
    checkpoint_dir(spark)


def test_percentiles(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(9)]), r.randint(0, 3)) for _ in range(300)] + [("empty", None, 1)]
    df = spark.createDataFrame(rows, "k string, v int, w int")
    shares = {"p5": 0.05, "p50": 0.5, "p99": 0.99}
    got = {x["k"]: tuple(x)[1:] for x in aggregates.percentiles(df, ["k"], "v", shares).collect()}
    want = {k: tuple(np.quantile([v for j, v, _ in rows if j == k and v is not None], list(shares.values()))) for k in ("a", "b", None)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    got = aggregates.percentiles(df, [], "v", shares, "w").first()
    assert np.allclose(got, np.quantile([v for _, v, w in rows if v is not None for _ in range(w)], list(shares.values())))
    assert aggregates.percentiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_block_pairs_in_tiles(spark):
    rows = [(k, "x" if k % 3 else f"b{k % 7}", k % 5) for k in range(200)] + [(500, None, 1)]
    df = spark.createDataFrame(rows, "PATID int, block string, c int")
    want = {(a, b, x, y) for a, k, x in rows for b, j, y in rows if k is not None and k == j and a < b}
    for tile in (4096, 10):
        got = pairs.block_pairs(df, ["block"], "PATID", ["c"], tile).select("PATID_A", "PATID_B", "c_a", "c_b").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_tokens_are_near_by_pairs_or_blocks(spark):
    """The same decisions whether equivalent tokens are looked for in the blocks, in the pairs, or in wide rows."""
    g = generate.matches(spark, 60, 3).unionByName(generate.nonmatches(spark, 60, 3, 1000)).checkpoint()
    recs = generate.records_of(g).withColumn("all", F.lit(1))
    p = g.select("PATID_A", "PATID_B")
    by_pairs = {tuple(x) for x in rules.classify(p, recs).collect()}
    by_blocks = {tuple(x) for x in rules.classify(p, recs, block_keys=["all"]).collect()}
    wide = {(x["PATID_A"], x["PATID_B"], x["rule_pred"], x["rule_id"], x["rule_reason"]) for x in rules.classify_wide(g).collect()}
    assert len(by_pairs) == 120 and by_pairs == by_blocks == wide
    near = {x["token"]: set(x["near"]) for x in near_tokens(spark.createDataFrame([("BOB", "ROBERT"), ("ANN", "XU"), ("MARTA", "MARTHA")], "t string, u string")).collect()}
    assert near == {"BOB": {"ROBERT"}, "ROBERT": {"BOB"}, "MARTA": {"MARTHA"}, "MARTHA": {"MARTA"}}


def test_positions(spark):
    df = spark.createDataFrame([(k * 3 % 101, f"r{k}") for k in range(100)], "key int, v string")
    assert {x["key"]: x["position"] for x in records.positioned(df, "key").collect()} == {k: i for i, k in enumerate(sorted(k * 3 % 101 for k in range(100)))}
    turns = Counter(x["turn"] for x in sampling.round_robin(df, 7, "key").collect())
    assert max(turns.values()) - min(turns.values()) == 1 and set(turns) == set(range(7))
    with pytest.raises(ValueError):
        records.aligned(df, df.limit(99).withColumnRenamed("key", "other"), "key", "other")
    with pytest.raises(ValueError):
        records.renamed(df, ["only"])


def test_first_of_class_is_exact_where_few_fall_below_the_bound(spark):
    rows = [(f"c{k % 3}", k) for k in range(3000)] + [("rare", 5000)]
    df = spark.createDataFrame(rows, "attribute string, key int").withColumn("label", F.lit(0))
    got = sampling.downsample_attributes(df, "key", most=40)
    plain = sampling.top_per_class(df, ["attribute"], 40, 43, "key")
    assert Counter(x["attribute"] for x in got.collect()) == {"c0": 40, "c1": 40, "c2": 40, "rare": 1}
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in plain.select(*got.columns).collect()}


def test_padded_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(k, t) for k, t in enumerate(["", None, "Hello world", "word " * 50, "<|endoftext|> x", "é漢"])]
    made = score.tokenized(spark.createDataFrame(texts, "id int, text string"), path, 12, 50256)
    library = Tokenizer.from_file(path)
    for x in made.collect():
        ids = library.encode(dict(texts)[x["id"]] or "", add_special_tokens=False).ids
        assert x["n_tokens"] == len(ids)
        if len(ids) > 12:
            assert x["ids"] is None and x["mask"] is None
        else:
            assert x["ids"] == ids + [50256] * (12 - len(ids)) and x["mask"] == [int(i != 50256) for i in x["ids"]]
    kept, report = score.within_length(made, F.col("n_tokens"), 12)
    assert tuple(report.first()) == (5, 1) and kept.count() == 5
    with pytest.raises(ValueError):
        score.within_length(made, F.col("n_tokens"), 12, strict=True)


def test_entity_first_records(spark):
    got = generate.entity_records(spark, 3000, 7).collect()
    sizes = Counter(Counter(x["entity_id"] for x in got).values())
    assert len({x["PATID"] for x in got}) == len(got) and set(sizes) <= {1, 2, 3, 4, 5} and 0.78 < sizes[1] / 3000 < 0.9
    first = {x["entity_id"]: x for x in got if x["PATID"].endswith("R1")}
    drifted = [(first[x["entity_id"]], x) for x in got if not x["PATID"].endswith("R1")]
    moved = sum(a["address"] != b["address"] for a, b in drifted) / len(drifted)
    named = sum(a["last_name"] != b["last_name"] for a, b in drifted) / len(drifted)
    assert 0.6 < moved < 0.8 and 0.2 < named < 0.36 and all(a["ssn"] == b["ssn"] for a, b in drifted)
    again = generate.entity_records(spark, 3000, 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    share = spark.range(20000).where(generate.held_out(F.col("id"), 1)).count() / 20000
    assert 0.14 < share < 0.16


def test_enforced_bands(spark):
    m = generate.matches(spark, 900, 9).withColumn("band", F.element_at(F.array(F.lit("easy"), F.lit("last4"), F.lit("hard")), (F.col("entity_id_a") % 3 + 1).cast("int")))
    for x in generate.enforce_band(m, F.col("band"), 9).collect():
        if x["band"] == "easy":
            assert x["ssn_l"] == x["ssn_r"] and x["ssn4_l"] == x["ssn4_r"] == x["ssn_l"][-4:]
        elif x["band"] == "last4":
            assert x["ssn_l"] is None and x["ssn_r"] is None and x["ssn4_l"] == x["ssn4_r"]
        else:
            assert (x["ssn_l"] is None or x["ssn_l"] != x["ssn_r"]) and (x["ssn4_l"] is None or x["ssn4_l"] != x["ssn4_r"])
        assert any(x[f"{f}_l"] != x[f"{f}_r"] for f in ("first_name", "last_name", "dob", "address"))


def test_reports_of_a_corpus(spark):
    p = generate.build_test(spark, 400).checkpoint()
    rows = qa.distributions(p).collect()
    assert {x["part"] for x in rows} == {"state", "sex", "decade", "email_domain", "ssn_band"}
    for part in {x["part"] for x in rows}:
        assert abs(sum(x["share"] for x in rows if x["part"] == part) - 1) < 0.01
    real = spark.createDataFrame([("sex", "FEMALE", 0.5), ("state", "ZZ", 0.1)], "part string, value string, share double")
    beside = {(x["part"], x["value"]): x for x in qa.distributions(p, real).collect()}
    assert beside["state", "ZZ"]["difference"] == -0.1 and beside["sex", "FEMALE"]["real_share"] == 0.5
    twice = p.unionByName(p.limit(3))
    assert qa.repeated_pairs(p).count() == 0 and qa.repeated_pairs(twice).count() == 3


def test_pools(spark):
    rows = [("MARIA", "100 N OAK ST")] * 30 + [("TEST", "5 TEST AVE")] * 30 + [("RARE", "7 LONE RD")] * 3 + [(None, None)]
    got = generate.build_pools(spark.createDataFrame(rows, "first_name string, address string"), ("first_name",))
    assert got["first_name"]["weighted_head"] == [["MARIA", 30]] and "OAK" in got["street"]["names"] and "LONE" not in got["street"]["names"]
    assert set(FEATURES) >= {"first_name", "address"}


def test_shared_keys_and_rules_of_a_corpus(spark):
    p = generate.build_test(spark, 300).checkpoint()
    rows = p.where("label = 0").collect()
    phones = lambda x: x["phone_l"] is not None and x["phone_r"] is not None and bool(set(x["phone_l"].split()) & set(x["phone_r"].split()))
    want = Counter(sum(x[f"{f}_l"] is not None and x[f"{f}_l"] == x[f"{f}_r"] for f in qa.STRONG) + phones(x) for x in rows)
    assert {x["keys"]: x["n"] for x in qa.shared_key_histogram(p).collect()} == dict(want)
    out = rules.classify(p.select("PATID_A", "PATID_B", "label"), generate.records_of(p)).collect()
    assert len(out) == 300 and sum(x["label"] == 0 and x["rule_pred"] == "match" for x in out) < 15


def test_replaced_tables_and_models(spark, tmp_path):
    at = str(tmp_path / "t")
    first = sinks.replace_table(spark.range(5), at)
    assert sinks.replace_table(first.where("id > 2"), at).count() == 2  # a table may be replaced by what reads it
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    p = spark.createDataFrame([(str(k), str(k + 1), "ANN" if k % 2 else "BOB", "ANN", k % 2) for k in range(40)], "PATID_A string, PATID_B string, first_name_a string, first_name_b string, label int")
    model = score.train_scorer(p, ["first_name"])
    sinks.save_model(model, str(tmp_path / "m"))
    a, b = score.predictions(model, p, ["first_name"]).collect(), score.predictions(sinks.load_model(str(tmp_path / "m")), p, ["first_name"]).collect()
    assert a == b and all(abs(x["proba_0"] + x["proba_1"] - 1) < 1e-5 and x["prediction"] == int(x["PATID_A"]) % 2 for x in a)
    sinks.write_epochs(spark, str(tmp_path / "epochs"), [{"epoch": 1, "loss": 0.5, "score": 0.7, "seconds": 3}])
    assert spark.read.csv(str(tmp_path / "epochs"), header=True).first().asDict() == {"epoch": "1", "loss": "0.5", "score": "0.7", "seconds": "3.0"}
    sinks.write_pools({"street": {"names": ["OAK"]}}, str(tmp_path / "pools"), spark)
    assert sinks.read_report(spark, str(tmp_path / "pools" / "street.json")) == {"names": ["OAK"]}


def test_throughput_counts_padding(spark):
    texts = spark.createDataFrame([("a",), ("bb",), ("cccc",), ("d",)], "text string").coalesce(1)
    got = score.throughput(texts, lambda: lambda batch: [(1, 0.5) for _ in batch], F.length("text"), batch=2, runs=1)
    assert got["rows"] == 4 and got["tokens"] == 2 * 1 + 2 * 4 and got["rows_per_second"] > 0


def test_pairs_with_fields_are_not_moved(spark):
    """Pairs are made with their records' fields: each side of the blocks is dealt out once, and nothing is dealt by a pair's ids."""
    from pairloom.queries import registry

    q = registry.queries()
    for name in ("serialize_mode1", "serialize_mode4", "prompt_texts", "payload_json", "a_over_b_rows", "valid_pairs_semi", "rules_without_typos", "dob_relation", "uncertain_topk", "attach_left_joinable"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(PATID_A" not in plan and "hashpartitioning(PATID_B" not in plan, name


def test_fields_of_blocks_as_attached(spark):
    from pairloom.operators.pairs import attach, block_pairs, block_wide
    from pairloom.operators.rules import classify, classify_blocks
    from pairloom.queries.patient import BLOCK, FIELDS, patients

    recs = patients(spark, "/root/testdata/sf0.001")
    made = block_wide(recs, BLOCK, FIELDS, ("l", "r"), carry=["entity"])
    p = block_pairs(recs, BLOCK, "PATID", ["entity"])
    want = attach(p, recs, FIELDS, ("l", "r")).select(*made.columns)
    assert made.count() == want.count() > 0 and made.exceptAll(want).count() == 0
    made = classify_blocks(recs, BLOCK, carry=["entity"])
    want = classify(p, recs, block_keys=BLOCK).select(*made.columns)
    assert made.count() == want.count() and made.exceptAll(want).count() == 0


def test_first_drawn_is_sample_exact(spark):
    from pairloom.operators.sampling import first_drawn, sample_exact

    df = spark.range(3000).selectExpr("id", "id % 3 AS v")
    for n, total in ((0, 3000), (40, 3000), (900, 3000), (2990, 3000), (50, 3_000_000), (4000, 3000)):
        assert sorted(map(tuple, first_drawn(df, n, total, 5, "id").collect())) == sorted(map(tuple, sample_exact(df, n, 5, "id").collect())), (n, total)


def test_runs_by_first_record(spark):
    """The pairs that the joins of two tables of pairs leave, without such a join."""
    from pairloom.operators.pairs import block_pairs, first_marked, not_written, with_predictions

    df = spark.createDataFrame([(k, f"b{k % 4}") for k in range(60)], "PATID int, block string")
    done = df.where("PATID % 3 = 0")
    made = block_pairs(first_marked(df, done.union(done), "done"), ["block"], carry=["done"])
    every = block_pairs(df, ["block"])
    written = every.where("PATID_A % 3 = 0")
    left = sorted(map(tuple, made.where("NOT done_a").select("PATID_A", "PATID_B").collect()))
    assert left == sorted(map(tuple, not_written(every, written).collect())) and left
    report = with_predictions(every, written)[1].first()
    assert (report["pairs"], report["missing"]) == (made.count(), len(left))


@pytest.mark.parametrize("name", ["resume_anti", "missing_predictions"])
def test_pairs_are_not_joined_by_id(spark, name):
    from pairloom.queries import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("PATID_B" in line and "PATID_A" in line and "<" not in line for line in joins)
