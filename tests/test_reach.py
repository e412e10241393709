"""Names are matched token by token only where a token of one is reached from the other, in methods that the JVM compiles."""

from pyspark.sql import functions as F

from pairloom.functions.similarity import near_tokens
from pairloom.operators import rules


def test_reach_has_all_that_may_match(spark):
    names = ["ROBERT A SMITH", "BOB SMITH", "SMIHT ROB", "A", "", "MARIA LEE-LI", "MARI LI", "KIM ROSA", "ANNE ALBERT"]
    records = spark.createDataFrame([(f"P{k}", 1, n) for k, n in enumerate(names)], "PATID string, b int, first_name string")
    for f in ("middle_name", "last_name", "suffix", "dob", "ssn", "ssn4", "address", "zip", "phone", "email"):
        records = records.withColumn(f, F.lit(None).cast("string"))
    facts = rules.with_near(rules.record_facts(records, "PATID"), near_tokens(rules.block_tokens(records, ["b"])))
    own = F.struct(*[c for c in facts.columns if c != "PATID"])
    pairs = facts.select(F.col("PATID").alias("A"), own.alias("l")).crossJoin(facts.select(F.col("PATID").alias("B"), own.alias("r"))).where("A != B AND size(l.tokens) > 0 AND size(r.tokens) > 0")
    a, b = F.col("l"), F.col("r")
    small = F.size(a["tokens"]) <= F.size(b["tokens"])
    one_by_one = rules.greedy_matches(F.when(small, a["named"]).otherwise(b["named"]), F.when(small, b["named"]).otherwise(a["named"]))
    rows = pairs.select(rules.matched_tokens(a, b).alias("n"), one_by_one.alias("m"), F.arrays_overlap(a["reach"], b["tokens"]).alias("met")).collect()
    assert all(r["n"] in (None, r["m"]) for r in rows) and all(r["met"] == (r["m"] > 0) for r in rows)
    assert {r["met"] for r in rows} == {True, False}


def test_the_cascade_is_dealt_to_small_methods(spark):
    from pairloom.queries import registry

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    registry.queries()["agreement_profile"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
