"""Per-user recommendations from association rules.

The README of the reference promises recommendations ranked by confidence
but gives no details; the semantics here: rule A -> c applies to user u if
A is in u's basket and c is not; score(u, c) is the largest confidence of
the applicable rules; rank by score descending, then item ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import ROW_OVERHEAD, key_bytes, materialize, maybe_broadcast, new_scratch
from . import prepare as prep
from .containment import basket_kinds, held_by_kinds
from .rules import filter_rules

USER, ITEM = prep.USER, prep.ITEM


WHOLE_LATTICE = 8        # antecedents up to this size are held against all their subsets


def undominated_rules(rules: DataFrame) -> DataFrame:
    """Rules (antecedent, consequent, confidence) that can set a score.

    A rule A -> c never does if some proper subset B of A has a rule B -> c with at
    least its confidence: whoever holds A holds B.  All subsets of antecedents up
    to WHOLE_LATTICE members are looked up, of longer ones those one member
    shorter; a dominated rule that is overlooked only costs time.
    """
    kind = rules.schema["antecedent"].dataType.simpleString()
    every = (f"aggregate(antecedent, array(cast(array() as {kind})), "
             "(acc, x) -> concat(acc, transform(acc, s -> concat(s, array(x)))))")
    shorter = "transform(antecedent, x -> array_remove(antecedent, x))"
    subsets = (f"filter(if(size(antecedent) <= {WHOLE_LATTICE}, {every}, {shorter}), "
               "s -> size(s) > 0 and size(s) < size(antecedent))")
    parts = rules.selectExpr("antecedent", "consequent", "confidence", f"explode_outer({subsets}) as part")
    known = rules.selectExpr("antecedent as part", "consequent", "confidence as _less").distinct()
    return (parts.join(known, ["part", "consequent"], "left").groupBy("antecedent", "consequent", "confidence")
            .agg(F.max("_less").alias("_less")).filter("_less IS NULL OR _less < confidence")
            .select("antecedent", "consequent", "confidence"))


def recommend(baskets, rules: DataFrame | None = None, min_confidence: float | None = None,
              top_n: int | None = None) -> DataFrame:
    """(user_id, item_id, score, rank) for every user with an applicable rule.

    `baskets` is a table (user_id, items), e.g. of new users, or a MiningResult.
    A MiningResult without `rules` takes its own rules, whose antecedents are
    looked up in the classes the miner kept.  For any other rules the
    holders of the antecedents are found in the baskets, so rules of any depth
    apply.  Rules that another one dominates are left out first, which changes no
    score.  They are then applied and ranked once per distinct basket, and the
    users of each basket joined last; items already there are looked up in the
    basket itself (as in a join, a null user has none).  For a MiningResult's own rules the best score per (user, item)
    is aggregated before the anti-join that drops such items.  The ranking window
    is per user or basket, whose rows are bounded by the number of consequents.
    """
    plain = isinstance(baskets, DataFrame)
    if plain and rules is None:
        raise ValueError("rules are required with a table of baskets")
    own = rules is None
    rules = baskets.rules() if own else rules
    if min_confidence is not None:
        rules = filter_rules(rules, min_confidence)
    r = (undominated_rules(rules.select("antecedent", "consequent", "confidence"))
         .withColumnRenamed("consequent", ITEM))
    if own:
        held, n_bytes = _kept_occurrences(baskets), _rules_bytes(baskets.levels)
        pairs = baskets.level(1).occurrences.select(USER, F.col("last").alias(ITEM))
    else:
        r = materialize(r, new_scratch(r.sparkSession, "rules"))     # read three times
        scratch = new_scratch(r.sparkSession, "recommend")
        kinds = basket_kinds(baskets if plain else baskets.baskets(), scratch)
        held, _ = held_by_kinds(kinds, r.select(F.col("antecedent").alias("items")), scratch)
        n_bytes = r.agg(F.coalesce(F.sum(key_bytes(r, ["antecedent", ITEM])), F.lit(0))).first()[0]
    applied = held.withColumnRenamed("items", "antecedent").join(
        maybe_broadcast(r, int(n_bytes)), "antecedent", "inner")
    who = [USER] if own else ["kind", "basket", "anon"]
    if not own:
        applied = applied.filter(F.col("anon") | ~F.coalesce(F.array_contains("basket", F.col(ITEM)), F.lit(False)))
    best = applied.groupBy(*who, ITEM).agg(F.max("confidence").alias("score"))
    if own:
        best = best.join(pairs, [USER, ITEM], "left_anti")
    order = Window.partitionBy(who[0]).orderBy(F.desc("score"), F.asc(ITEM))
    ranked = best.withColumn("rank", F.row_number().over(order))
    if top_n is not None:
        ranked = ranked.filter(F.col("rank") <= top_n)
    return ranked if own else kinds.of_users(ranked.drop("kind"), f"{scratch}/ranked")


def _rules_bytes(levels) -> int:
    """Upper bound of a run's rule table: level k has k rules per set, each no longer than the set."""
    item = levels[0].max_item_len + 8
    return sum(lv.k * lv.n_frequent * (2 * ROW_OVERHEAD + (lv.k + 1) * item) for lv in levels[1:])


def _kept_occurrences(result) -> DataFrame:
    """(user_id, items) of every level that has rules above it."""
    held = None
    for lv in result.levels[:-1]:
        result.written_classes(lv.k)
        part = lv.occurrence_sets()
        held = part if held is None else held.unionByName(part)
    if held is None:
        raise ValueError("no levels were mined")
    return held
