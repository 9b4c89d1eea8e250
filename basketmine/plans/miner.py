"""Level-wise frequent-itemset mining (Apriori) as a chain of Spark jobs.

Data kept per level k:

* ``L_k(k, prefix, last, items, freq, support)`` -- frequent k-sets (cached); the
  set is ``prefix + [last]`` (sorted, so ``last`` is its largest member).
* ``classes_k(user_id, prefix, exts)`` -- per user and shared prefix the last
  items of the frequent k-sets that the user holds (see `operators.classes`).

Growing the classes is a narrow step, so levels are counted without a join: all
sets of the next level, and of the levels after it while they are few, come from
one plan and go into one aggregate keyed by the set.  How far a job looks ahead
follows from class sizes measured in flight, while the classes are written: it
may cost as much again as the next level alone, or AHEAD_ROWS rows.  Only
combinations that really occur in some basket are ever counted, no basket array
is scanned for containment, and nothing of the grown rows is stored.

Only the last level of a job is written as classes, and only if the loop goes on;
the classes between, and those of the last level, are plans over the written
ones, filtered by the level tables, for whoever needs them.

Level tables are small and cached (their lineage is one step back to the last
written classes); class tables are written to shared storage, which cuts the
lineage of the loop.

Loop control follows the reference: level 2 always runs, then continue
while the last level has more than one set and the next size is within
``max_len``.  Levels counted ahead beyond that are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import is_frequent, support
from ..operators import classes as cls
from ..operators import prepare as prep
from ..operators.pairs import DEFAULT_SKEW, SkewPolicy
from .runtime import ROW_OVERHEAD, delete_path, materialize, materialize_measured, maybe_broadcast, new_scratch

USER, ITEM = prep.USER, prep.ITEM
AHEAD_ROWS = 6_000_000      # counted rows that cost no more than a job of their own


@dataclass
class Level:
    k: int
    table: DataFrame            # k, prefix, last, items, freq, support
    n_frequent: int
    make_classes: Callable[[], DataFrame]   # user_id, prefix, exts
    n_occurrences: int          # users x sets held: the sum of freq
    n_bytes: int = 0            # upper bound of the table's size
    max_item_len: int = 0       # longest item text (level 1)
    metrics: dict | None = None     # of the classes, where they are written

    def itemsets(self) -> DataFrame:
        return self.table.select("k", "items", "freq", "support")

    @cached_property
    def classes(self) -> DataFrame:
        """(user_id, prefix, exts): written, or a plan over the written ones below."""
        return self.make_classes()

    @property
    def occurrences(self) -> DataFrame:
        """(user_id, prefix, last) for every frequent k-set a user holds."""
        return cls.held(self.classes)

    def occurrence_sets(self) -> DataFrame:
        """(user_id, items) for every frequent k-set a user holds."""
        return self.occurrences.select(USER, F.concat("prefix", F.array("last")).alias("items"))


@dataclass
class MiningResult:
    n_users: int
    min_support: float
    pairs: DataFrame            # distinct (user_id, item_id), basket side
    levels: list[Level]
    scratch: str
    item_freq: DataFrame | None = None   # (item_id, freq, support), all items
    all_items: DataFrame | None = None   # distinct items within the item bound
    skew: SkewPolicy = field(default=DEFAULT_SKEW)
    cached: list[DataFrame] = field(default_factory=list)

    def level(self, k: int) -> Level:
        return self.levels[k - 1]

    @property
    def max_k(self) -> int:
        return len(self.levels)

    def itemsets(self, max_len: int | None = None) -> DataFrame:
        """All frequent sets: (k, items, freq, support)."""
        keep = [lv for lv in self.levels if max_len is None or lv.k <= max_len]
        out = keep[0].itemsets()
        for lv in keep[1:]:
            out = out.unionByName(lv.itemsets())
        return out

    def frequent_items(self) -> DataFrame:
        return self.levels[0].table.select(F.col("last").alias(ITEM), "freq", "support")

    def baskets(self) -> DataFrame:
        """user -> sorted frequent items (the reference's users file)."""
        return self.levels[0].classes.select(USER, F.col("exts").alias("items"))

    def written_classes(self, k: int) -> DataFrame:
        """The classes of level k on shared storage; written from those of the level below if need be."""
        lv = self.level(k)
        if lv.metrics is None:
            self.written_classes(k - 1)
            above = _classes_above(self.level(k - 1), lv.table, lv.n_bytes, self.skew)
            lv.classes, lv.metrics = _write_classes(above, f"{self.scratch}/classes/k={k}")
        return lv.classes

    def rules(self) -> DataFrame:
        from ..operators.rules import association_rules
        return association_rules(self)

    def stats(self, candidates: DataFrame | None = None) -> DataFrame:
        from ..operators.support import iteration_stats
        return iteration_stats(self, candidates)

    def cleanup(self) -> None:
        """Delete this run's files on shared storage and its cached tables (call when done)."""
        for table in self.cached:
            table.unpersist()
        delete_path(self.pairs.sparkSession, self.scratch)


def _cache_levels(table: DataFrame, measure_items: bool = False) -> tuple[DataFrame, dict]:
    """Cache the table of one or more levels; returns it with (n, occ, len) by k, all from one aggregate.

    Each (user, set) containment is counted once, so the total count is the
    number of the level's occurrences; `len` is the longest text of its items (level 1 only).
    """
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    longest = F.max(F.octet_length(F.col("last").cast("string"))) if measure_items else F.lit(0)
    rows = table.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("occ"),
                                  longest.alias("len")).collect()       # one row per level
    return table, {r["k"]: (int(r["n"]), int(r["occ"]), int(r["len"])) for r in rows}


def level_bytes(n_sets: int, k: int, max_item_len: int) -> int:
    """Upper bound of a level table's size.  Every member of a frequent set
    is a frequent item, so no member is longer than the longest one."""
    return n_sets * (ROW_OVERHEAD + 16 + k * (max_item_len + 8))


def _write_classes(classes: DataFrame, path: str) -> tuple[DataFrame, dict]:
    return materialize_measured(classes, path, cls.size_metrics())


def _level_one(pairs: DataFrame, item_freq: DataFrame, n_users: int, min_support: float,
               scratch: str) -> Level:
    item_type = pairs.schema[ITEM].dataType.simpleString()
    empty = F.array().cast(f"array<{item_type}>")
    table = (prep.frequent_items(item_freq, n_users, min_support)
             .select(F.lit(1).alias("k"), empty.alias("prefix"), F.col(ITEM).alias("last"),
                     F.array(ITEM).alias("items"), "freq", "support"))
    table, found = _cache_levels(table, measure_items=True)
    n1, n_occ, item_len = found.get(1, (0, 0, 0))
    n_bytes = level_bytes(n1, 1, item_len)
    kept = pairs.join(maybe_broadcast(table.select(F.col("last").alias(ITEM)), n_bytes), ITEM, "left_semi")
    classes, metrics = _write_classes(cls.first_classes(kept), f"{scratch}/classes/k=1")
    return Level(1, table, n1, lambda: classes, n_occ, n_bytes, item_len, metrics)


def _classes_above(prev: Level, table: DataFrame, n_bytes: int, skew: SkewPolicy) -> DataFrame:
    """The classes of the level whose frequent sets are `table`, from those of the level below."""
    largest = prev.metrics["largest"] if prev.metrics else 0
    return cls.keep_frequent(cls.grow(prev.classes, largest, skew), table, n_bytes)


def mine(ratings: DataFrame, min_support: float, max_len: int | None = None, *,
         max_item=None, max_user=None, user_bound: str = "inclusive",
         l1_count: str = "distinct", user_col: str = USER, item_col: str = ITEM,
         skew: SkewPolicy = DEFAULT_SKEW, ahead_rows: int = AHEAD_ROWS,
         scratch: str | None = None) -> MiningResult:
    """Mine all itemsets with support > min_support (M1).

    ratings       any DataFrame with a user and an item column
    max_len       largest set size; like the reference's iteration limit,
                  values below 2 still run level 2
    max_item/max_user  inclusive ID bounds (P3, P4)
    user_bound    "inclusive" (default) or "reference": N keeps user <=
                  max_user, baskets and level 1 keep user < max_user (Q3)
    l1_count      "distinct" (default) or "rows": level-1 support counts
                  rating rows, as the reference does (Q5)
    ahead_rows    counted rows up to which a job may look levels ahead; the
                  result does not depend on it
    """
    if min_support is None or not min_support >= 0:
        raise ValueError("min_support is required and must not be negative")
    if user_bound not in ("inclusive", "reference"):
        raise ValueError("user_bound must be 'inclusive' or 'reference'")
    spark = ratings.sparkSession
    scratch = scratch or new_scratch(spark, "mine")

    rated = prep.bounded_ratings(prep.as_ratings(ratings, user_col, item_col), max_item=max_item)
    strict = user_bound == "reference" and max_user is not None
    basket_rows = prep.bounded_ratings(rated, max_user=max_user, strict_user=strict)

    # Distinct (user, item) within the item bound, written once; the user
    # bounds are filters on this file (pushed down to the scan).
    all_pairs = materialize(prep.distinct_pairs(rated), f"{scratch}/pairs")
    pairs = prep.bounded_ratings(all_pairs, max_user=max_user, strict_user=strict)
    n_users = prep.count_users(prep.bounded_ratings(all_pairs, max_user=max_user))
    if l1_count not in ("distinct", "rows"):
        raise ValueError("l1_count must be 'distinct' or 'rows'")
    # `pairs` is already distinct: counting its rows is the distinct count.
    item_freq = prep.item_support(basket_rows if l1_count == "rows" else pairs, n_users,
                                  count="rows")
    first = _level_one(pairs, item_freq, n_users, min_support, scratch)
    levels, cached = [first], [first.table]

    limit = max(2, max_len) if max_len is not None else None
    while True:
        base = levels[-1]
        ahead = cls.levels_ahead(base.metrics, ahead_rows)
        if limit is not None:
            ahead = min(ahead, limit - base.k)
        # Counted in the stage that grows them: the rows are never stored.
        sets = (cls.count_ahead(base.classes, ahead) if ahead > 1
                else cls.count_next(base.classes, base.metrics["largest"], skew))
        counted = sets.filter(is_frequent("freq", n_users, min_support))
        table, found = _cache_levels(counted.withColumn("support", support("freq", n_users)))
        cached.append(table)
        for k in range(base.k + 1, base.k + 1 + ahead):
            n_k, n_occ, _ = found.get(k, (0, 0, 0))
            n_bytes = level_bytes(n_k, k, first.max_item_len)
            part = table.filter(F.col("k") == k)
            levels.append(Level(k, part, n_k, partial(_classes_above, levels[-1], part, n_bytes, skew), n_occ, n_bytes))
            go_on = n_k > 1 and (limit is None or k + 1 <= limit)
            if not go_on:
                break
        if not go_on:
            break
        last = levels[-1]
        classes, last.metrics = _write_classes(last.classes, f"{scratch}/classes/k={last.k}")
        last.classes = classes

    return MiningResult(n_users, min_support, pairs, levels, scratch, item_freq,
                        all_pairs.select(ITEM).distinct(), skew, cached)
