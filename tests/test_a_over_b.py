"""Pairs for reading, side above side, whose fields are normalised before pairs are made."""

from pairloom.operators import labels as L
from pairloom.operators.pairs import block_wide


def test_sides_of_blocks_are_those_of_their_pairs(spark):
    texts = ["Ann", " ANN", "ann\t", "", None, "é", "É ", "N/A", "B"]
    rows = [(f"P{k}", k % 3 or None, texts[k % 9], texts[k * 5 % 7]) for k in range(60)]
    records = spark.createDataFrame(rows, "PATID string, b int, x string, y string")
    want = L.a_over_b(block_wide(records, ["b"], ["x", "y"]), ["x", "y"])
    got = L.a_over_b_of_blocks(records, ["b"], ["x", "y"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 760


def test_no_text_is_normalised_once_a_pair(spark):
    from pairloom.queries import registry

    plan = registry.queries()["a_over_b_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[: plan.index("Join ")]
