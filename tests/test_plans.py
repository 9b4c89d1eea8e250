"""Physical-plan checks: no cross/nested-loop joins and no Python UDFs, levels
counted without a join, column pruning at the scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from basketmine import mine
from basketmine.operators.classes import count_ahead, count_next
from basketmine.operators.containment import held_sets, holders
from basketmine.sources import tables

SF = "/root/testdata/sf0.001"
# no cross or nested-loop joins, and no Python evaluation (row or Arrow UDFs)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython")


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["frequent_itemsets", "association_rules", "candidates_k3",
                                  "candidate_support_k3", "retained_baskets",
                                  "recommendations_types", "normalize_raw_blocks",
                                  "skip_malformed_ratings"])
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


def test_levels_are_counted_without_a_join(spark):
    res = mine(tables.order_types(spark, SF), 0.05, max_len=2)
    for counted in (count_next(res.level(1).classes), count_ahead(res.level(1).classes, 4)):
        plan = plan_of(counted)
        assert "Join" not in plan and plan.count("Exchange") <= 2      # of the sets' counts only
        assert "partial_count" in plan                                 # pre-aggregated before shuffling
        assert not re.search(r"hashpartitioning\(user_id", plan)


def _jobs(spark, work):
    group = "jobs-of-a-test"
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_several_levels_take_one_count(spark):
    """Looking ahead saves the jobs of the levels between."""
    ratings = tables.order_types(spark, SF)
    levels = []
    ahead = _jobs(spark, lambda: levels.append(mine(ratings, 0.05).max_k))
    single = _jobs(spark, lambda: levels.append(mine(ratings, 0.05, ahead_rows=0).max_k))
    assert levels[0] == levels[1] >= 4
    assert ahead < single


def test_containment_joins_do_not_grow_with_the_sets(spark):
    baskets = spark.createDataFrame([(1, list(range(12)))], "user_id long, items array<long>")
    plans = []
    for size in (2, 10):
        sets = spark.createDataFrame([(list(range(size)),)], "items array<long>")
        plans.append(plan_of(held_sets(baskets, sets)))
    assert plans[0].count("Join") == plans[1].count("Join") > 0
    plan = plan_of(holders(baskets, sets))
    assert "LeftSemi" in plan


def test_fixture_scans_read_key_columns_only(spark):
    plan = plan_of(tables.order_types(spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in schemas
    assert "struct<p_partkey:bigint,p_type:string>" in schemas
