"""The join by hot keys against a plain left join."""

from pyspark.sql import functions as F

from pairloom.plans.hot import join_with_hot_keys


def test_join_with_hot_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else "hot" if k % 3 else f"k{k % 40}") for k in range(500)], "id int, key string")
    facts = rows.where("key IS NOT NULL AND key != 'k5'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.lit(None).cast("int").alias("none"))
    for share in (1, 4, 4096):
        got = join_with_hot_keys(rows, facts, "key", "n", 500, share)
        assert got.columns == ["id", "key", "least", "none"]
        want = rows.join(facts.drop("n"), "key", "left").select("id", "key", "least", "none")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_with_hot_keys(rows.limit(0), facts, "key", "n", 0).count() == 0
