"""Candidate support, basket retention and per-level statistics (M4, M5, M7).

The reference tests every basket against every candidate (a replicated
containment scan).  Here containment comes from the classes the miner kept: a
basket holds candidate c = a + b iff it holds both parents a and b, so
support is two equi-joins and a count, and retention is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import support
from . import classes as cls
from . import prepare as prep
from .candidates import generate_candidates, union_generators
from .pairs import pair_join

USER = prep.USER


def candidate_support(result, k: int, method: str = "union") -> DataFrame:
    """(k, items, freq, support) of every level-k candidate held by a basket.

    Only sets that a user actually holds are paired.  For candidates on plain
    tables see `containment.count_support`.
    """
    prev = result.level(k - 1)
    if k == 2 or method == "prefix":
        largest = prev.metrics["largest"] if prev.metrics else 0
        counted = cls.count_next(prev.classes, largest, result.skew)
        return (counted.select("k", "items", "freq")
                .withColumn("support", support("freq", result.n_users)))
    n1 = result.level(1).n_frequent
    gens = union_generators(prev.table, k, n_rows=prev.n_frequent, max_group=n1,
                            skew=result.skew)
    # Pairs of held (k-1)-sets that share k-2 items, counted per pair of sets
    # in the stage that joins them; then a count is taken when its pair is the
    # canonical generator of a candidate, so every (user, contained candidate)
    # counts exactly once and the generator join sees each pair of sets once.
    held = prev.occurrence_sets()
    parts = held.select(USER, "items", F.explode("items").alias("x"))
    parts = parts.select(USER, F.array_remove("items", F.col("x")).alias("rest"), "x")
    n_parts = None if prev.n_occurrences is None else prev.n_occurrences * (k - 1)
    pairs = pair_join(parts, [USER, "rest"], "x", n_rows=n_parts, max_group=n1,
                      skew=result.skew, left_name="x", right_name="y")
    counted = pairs.groupBy("rest", "x", "y").agg(F.count(F.lit(1)).alias("freq"))
    hits = counted.join(gens, ["rest", "x", "y"], "inner")
    return (hits
            .select(F.size("items").alias("k"), "items", "freq",
                    support("freq", result.n_users).alias("support")))


def _rests(classes: DataFrame, k: int) -> DataFrame:
    """(k, user_id, rest, n): the remainders of a user's sets when one item is taken away.

    A class row with two extensions shows by itself that two sets share all but
    one item; it stands as one row with n = 2.  Only the set of a row with a single
    extension, which can share its items with other such rows alone, is taken apart.
    """
    sets = "array(cast(null as array<{0}>))".format(classes.schema["exts"].dataType.elementType.simpleString())
    parts = "transform(concat(prefix, exts), x -> array_remove(concat(prefix, exts), x))"
    return classes.selectExpr(f"{k} as k", USER, f"explode(if(size(exts) > 1, {sets}, {parts})) as rest",
                              "if(size(exts) > 1, 2, 1) as n")


def _sharing_users(rests: DataFrame) -> DataFrame:
    """(k, user_id) of the users with a remainder of two sets."""
    return rests.groupBy("k", USER, "rest").agg(F.sum("n").alias("n")).filter("n > 1").select("k", USER).distinct()


def retained_users(result, k: int) -> DataFrame:
    """Users whose basket holds at least one level-k candidate.

    A union candidate is two frequent (k-1)-sets that share k-2 items, so a
    user qualifies iff two of the user's frequent (k-1)-sets do.  No pairs, no
    candidate table.
    """
    if k == 1:
        return result.level(1).classes.select(USER)
    return _sharing_users(_rests(result.level(k - 1).classes, k)).select(USER)


def retained_baskets(result, k: int) -> DataFrame:
    """Baskets (user_id, items) kept for level k; items unchanged (M5)."""
    return result.baskets().join(retained_users(result, k), USER, "left_semi")


def _retained_counts(result) -> dict[int, int]:
    """Retained users per level.

    Levels 1 and 2 were counted in flight when the first classes were written:
    every user with a frequent item, and every user with two.  The levels above
    are one job.
    """
    metrics = result.level(1).metrics
    out = {1: int(metrics["rows"]), 2: int(metrics["growing"])}
    above = [_rests(result.written_classes(lv.k - 1), lv.k) for lv in result.levels if lv.k >= 3]
    if above:
        rests = above[0]
        for part in above[1:]:
            rests = rests.unionByName(part)
        per = _sharing_users(rests).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out.update({r["k"]: r["n"] for r in per.collect()})      # one row per level
    return out


def _counts_by_level(parts: list[DataFrame]) -> dict[int, int]:
    """One job: row counts per level of several per-level frames."""
    if not parts:
        return {}
    allk = parts[0]
    for p in parts[1:]:
        allk = allk.unionByName(p)
    return {r["k"]: r["n"] for r in allk.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}


def iteration_stats(result, candidates: DataFrame | None = None) -> DataFrame:
    """(k, n_candidates, n_frequent, n_users, n_rules) for every level run.

    Level 1 counts every distinct item within the item bound as a candidate
    (the reference judges every movie block, whatever its raters).
    Candidates are the reference's union candidates; their count for k = 2
    is n1*(n1-1)/2.  Above that they are counted in `candidates` (k, items), if
    given, else generated for the count.  Candidates and retained users are one
    job each over all levels; the rule count is k * |L_k| (tested against the rule table).
    """
    n1 = result.level(1).n_frequent
    if candidates is not None:
        cands = [candidates.select("k").filter("k > 2")]
    else:
        cands = [generate_candidates(result.level(lv.k - 1).table, lv.k, "union",
                                     n_rows=result.level(lv.k - 1).n_frequent, max_group=n1,
                                     skew=result.skew).select("k")
                 for lv in result.levels if lv.k >= 3]
    n_cand = _counts_by_level(cands)
    n_cand[1] = result.all_items.count()
    if result.max_k >= 2:
        n_cand[2] = n1 * (n1 - 1) // 2
    n_users = _retained_counts(result)
    # Every antecedent of a frequent set is frequent (supports are exact and
    # anti-monotone), so level k has exactly k rules per frequent set.
    n_rules = {lv.k: lv.k * lv.n_frequent for lv in result.levels if lv.k >= 2}
    rows = [(lv.k, int(n_cand.get(lv.k, 0)), int(lv.n_frequent), int(n_users.get(lv.k, 0)),
             int(n_rules.get(lv.k, 0))) for lv in result.levels]
    spark = result.pairs.sparkSession
    return spark.createDataFrame(
        rows, "k int, n_candidates long, n_frequent long, n_users long, n_rules long")
