"""Candidate generation from a level table.

Two (k-1)-sets have a union of size k iff they share k-2 items, so the
reference's nested-loop "union of any two sets" becomes an equi-join on the
shared part:

* method="union"  (reference semantics, Q10): explode every set into
  (rest = set minus x, x), pair rows with equal rest and x < y, candidate =
  rest + x + y; one candidate is produced by every pair of its subsets
  that are frequent, so duplicates are removed by a groupBy that also
  picks one canonical parent pair (the smallest (x, y)).
* method="prefix" (textbook apriori-gen join step): pair sets with the
  same first k-2 items; every candidate is produced exactly once.

For k = 2 both are all pairs of frequent items.  The pairing runs through
`pair_join`, which splits a hot shared key (for k = 2 the empty set is
shared by all rows) over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import DEFAULT_SKEW, SkewPolicy, pair_join


def generate_candidates(level_table: DataFrame, k: int, method: str = "union", *,
                        n_rows: int | None = None, max_group: int | None = None,
                        skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """C_k from L_{k-1}: (k, items, parent_a, parent_b), items sorted.

    `max_group` bounds the rows sharing one key; the items under a key are
    distinct frequent items, so the size of level 1 is such a bound.
    """
    if method not in ("union", "prefix"):
        raise ValueError("method must be 'union' or 'prefix'")
    if method == "prefix" or k == 2:
        sets = level_table.select(F.slice("items", 1, F.size("items") - 1).alias("rest"),
                                  F.element_at("items", -1).alias("x"))
        pairs = pair_join(sets, ["rest"], "x", n_rows=n_rows, max_group=max_group, skew=skew)
        items = F.concat("rest", F.array("item_a", "item_b"))
        return pairs.select(
            F.size(items).alias("k"), items.alias("items"),
            F.concat("rest", F.array("item_a")).alias("parent_a"),
            F.concat("rest", F.array("item_b")).alias("parent_b"))
    gens = union_generators(level_table, k, n_rows=n_rows, max_group=max_group, skew=skew)
    return gens.select(
        F.size("items").alias("k"), "items",
        F.sort_array(F.concat("rest", F.array("x"))).alias("parent_a"),
        F.sort_array(F.concat("rest", F.array("y"))).alias("parent_b"))


def prune_candidates(candidates: DataFrame, level_table: DataFrame, k: int) -> DataFrame:
    """Candidates (k, items) all of whose (k-1)-subsets are in L_{k-1}.

    The textbook prune that the reference leaves out: every candidate is
    exploded into its k subsets, which are looked up in the level table.
    """
    subsets = candidates.select("k", "items", F.explode("items").alias("x"))
    subsets = subsets.select("k", "items", F.array_remove("items", F.col("x")).alias("_sub"))
    known = level_table.select(F.col("items").alias("_sub"))
    return (subsets.join(known, "_sub", "left_semi").groupBy("k", "items")
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == k).select("k", "items"))


def union_generators(level_table: DataFrame, k: int, *, n_rows: int | None = None,
                     max_group: int | None = None, skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Union candidates of size k >= 3 with one canonical generator each.

    (items, rest, x, y): items = rest + x + y, with rest + x and rest + y in
    L_{k-1}; of all generators of a candidate the smallest (x, y) is kept.
    """
    sets = level_table.select("items", F.explode("items").alias("x"))
    sets = sets.select(F.array_remove("items", F.col("x")).alias("rest"), "x")
    n_exploded = None if n_rows is None else n_rows * (k - 1)
    pairs = pair_join(sets, ["rest"], "x", n_rows=n_exploded, max_group=max_group,
                      skew=skew)
    cands = pairs.select(F.sort_array(F.concat("rest", F.array("item_a", "item_b"))).alias("items"),
                         F.struct(F.col("item_a").alias("x"), F.col("item_b").alias("y")).alias("xy"))
    best = cands.groupBy("items").agg(F.min("xy").alias("xy"))
    return best.select("items",
                       F.array_except("items", F.array(F.col("xy.x"), F.col("xy.y"))).alias("rest"),
                       F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))
