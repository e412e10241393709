"""The checks of generated pairs hold the reference's fields and limits, and the generator passes them."""

from pyspark.sql import functions as F

from pairloom.operators import generate as G
from pairloom.operators import qa


def test_violations_are_seen(spark):
    train, test = G.build_train(spark, 600), G.build_test(spark, 300)
    alike = train.withColumns({f"{f}_r": F.when(F.col("label") == 1, F.col(f"{f}_l")).otherwise(F.col(f"{f}_r")) for f in qa.PERSON})
    zips = test.withColumns({f"{f}_r": F.lit(None).cast("string") for f in (*qa.STRONG, "phone")} | {"zip_r": F.col("zip_l")})
    ok = {r["check_name"]: r["ok"] for r in qa.run_checks(alike, zips).collect()}
    assert not ok["train:no_identical_matches"] and not ok["test:negatives_share_a_key"] and not ok["train:address_equal_share"]
    assert {f"train:presence_{f}" for f in ("address", "phone", "dob", "last_name")} <= set(ok)


def test_generator_keeps_them(spark):
    train, test = G.build_train(spark, 6000), G.build_test(spark, 3000)
    checks = qa.run_checks(train, test)
    qa.require_hard(checks)
    limits = {r["check_name"]: r["threshold"] for r in checks.collect()}
    assert (limits["train:full_ssn_share"], limits["train:no_id_share"], limits["train:address_equal_share"]) == (0.07, 0.72, 0.34)
    bulk = G.nonmatches(spark, 4000, 7, 5_000_000, cases=["NM-HARD"])
    assert bulk.where(qa._shared() == 0).count() == 0
