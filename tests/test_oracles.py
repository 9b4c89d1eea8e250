"""Registered queries against their DuckDB oracles (a fast subset at sf0.01;
`python tests/oracle_check.py` runs all of them)."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.01"
FAST = ["distinct_user_count", "frequent_itemsets", "association_rules", "iteration_stats",
        "candidates_k3", "retained_baskets", "recommendations_top_n", "skip_malformed_ratings",
        "normalize_raw_blocks", "select_rating_files", "ragged_rating_lines", "crlf_rating_files",
        "split_bundled_blocks", "rules_from_text", "mine_from_rating_files"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    names = set(entry.queries())
    optional = {n for n in names if n.startswith("op") or n == "pipeline"}
    assert names - optional == set(entry.oracle_sql()) - optional


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["cols"], (r["spark_cols"], r["sql_cols"])
    assert r["ok"], r


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "antecedent", "consequent", "confidence", "support"]
    assert df.count() > 0
