"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import pytest
from tests.same import check, connect

from pairloom.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    check(QUERIES[name](spark, SF), duck, ORACLES[name])


#: Queries that SQL cannot express, with the test that holds each against a plain version or its invariants.
ELSEWHERE = {
    "generate_pairs": "test_generated_sizes", "generate_cases": "test_operators", "qa_suite": "test_qa", "qa_shared_keys": "test_records", "qa_repeated_pairs": "test_records", "qa_distributions": "test_records",
    "rules_on_generated": "test_records", "entity_first": "test_records", "enforced_bands": "test_records", "padded_tokens": "test_records", "score_pairs": "test_queries", "string_ratio_baseline": "test_string_ratio",
}


def test_each_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == set(ELSEWHERE)


def test_score_pairs(spark):
    rows = QUERIES["score_pairs"](spark, SF).collect()
    assert len({(r["PATID_A"], r["PATID_B"]) for r in rows}) == len(rows) > 0
    assert all(r["pred"] == (r["match_prob"] > 0.5) for r in rows if abs(r["match_prob"] - 0.5) > 1e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["rule_pred"] for r in e.entry(spark).collect()} == {"match", "non_match", "review"}
    assert set(e.oracle_sql()) <= set(e.queries())
