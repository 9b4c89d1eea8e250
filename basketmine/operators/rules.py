"""Single-consequent association rules with confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import confidence, remove_item, rule_text
from ..plans.runtime import maybe_broadcast


def level_rules(level_table: DataFrame, prev_table: DataFrame, prev_bytes: int, k: int) -> DataFrame:
    """Rules `s minus {x} -> x` for every frequent k-set s and member x.

    The antecedent's support is looked up in level k-1 with an equi-join on
    the antecedent set (inner, as in the reference: a rule is written only
    when its antecedent is frequent, which it always is).  Level k-1 is
    broadcast when its measured size bound is small, else the join shuffles.
    """
    exploded = level_table.select(
        "k", "items", "support", F.explode("items").alias("consequent"))
    exploded = exploded.withColumn("antecedent", remove_item("items", "consequent"))
    prev = prev_table.select(F.col("items").alias("antecedent"),
                             F.col("support").alias("antecedent_support"))
    joined = exploded.join(maybe_broadcast(prev, prev_bytes), "antecedent", "inner")
    return joined.select(
        "k", "antecedent", "consequent",
        confidence("support", "antecedent_support").alias("confidence"),
        "support", "antecedent_support")


def association_rules(itemsets) -> DataFrame:
    """Rules `s minus {x} -> x` of every set with two or more members.

    Takes a MiningResult, or any table (items, support) such as itemsets read
    back from files; there the antecedents are looked up in the same table.  A
    rule is given only if its antecedent is in the table.
    """
    if isinstance(itemsets, DataFrame):
        sets = itemsets.select(F.size("items").alias("k"), "items", "support")
        exploded = (sets.filter("k >= 2").withColumn("consequent", F.explode("items"))
                    .withColumn("antecedent", remove_item("items", "consequent")))
        known = sets.select(F.col("items").alias("antecedent"),
                            F.col("support").alias("antecedent_support"))
        return exploded.join(known, "antecedent").select(
            "k", "antecedent", "consequent",
            confidence("support", "antecedent_support").alias("confidence"),
            "support", "antecedent_support")
    out = None
    for lv in itemsets.levels[1:]:
        prev = itemsets.level(lv.k - 1)
        part = level_rules(lv.table, prev.table, prev.n_bytes, lv.k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("mining result has no level 2")
    return out


def filter_rules(rules: DataFrame, min_confidence: float) -> DataFrame:
    """Keep rules with confidence >= min_confidence."""
    return rules.filter(F.col("confidence") >= F.lit(float(min_confidence)))


def with_rule_text(rules: DataFrame) -> DataFrame:
    """Adds `rule`: `[a, b] -> c` (F8)."""
    return rules.withColumn("rule", rule_text("antecedent", "consequent"))
