"""Ordered self-join within groups, with hot groups dealt into block pairs.

`pair_join(df, keys, item)` returns one row per pair of rows of `df` with
equal `keys` and `a.item < b.item`.  Every level of the miner is built from
it: on occurrence tables (keys = user and shared prefix) the output is
exactly the set of (user, candidate) containments that support counting
has to see, and on level tables (keys = shared prefix or shared rest) it
is the candidate set.

Skew.  A group of m rows emits m(m-1)/2 pairs, so the danger is the output
of one group (a heavy user, or the empty prefix shared by all frequent
items when level-2 candidates are formed), which AQE cannot see because
the input partition is small.  A group whose pairs would exceed
`max_pairs_per_task` is dealt into b = ceil(m / sqrt(max_pairs_per_task))
buckets by a hash of the item, and every pair of buckets (i <= j) is joined
under a key of its own.  A bucket pair emits about `max_pairs_per_task` pairs
at most, whatever m is, each row is copied b + 1 times, and no pair is lost or
produced twice.

Hot groups are counted exactly.  Their list is broadcast only when its
measured size is below the session's broadcast threshold, and joined by a
shuffle beyond that.  When the caller can prove that no group is hot
(`max_group`, e.g. the number of frequent items, or `n_rows` below the
threshold), or when none is found, nothing is added to the plan.
AQE's skew-join split remains on as a second line.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import key_bytes, maybe_broadcast


@dataclass(frozen=True)
class SkewPolicy:
    max_pairs_per_task: int = 8_000_000   # pairs one group may emit in one task

    @property
    def hot_rows(self) -> int:
        """Group size whose pairs reach `max_pairs_per_task`."""
        return max(2, math.isqrt(2 * self.max_pairs_per_task))

    @property
    def bucket_rows(self) -> int:
        """Rows of one bucket of a hot group."""
        return max(1, math.isqrt(self.max_pairs_per_task))


DEFAULT_SKEW = SkewPolicy()


def hot_groups(df: DataFrame, keys: list[str], skew: SkewPolicy) -> DataFrame:
    """(keys..., _b): groups above the hot size, with their number of buckets."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
            .filter(F.col("_m") > skew.hot_rows)
            .select(*keys, F.ceil(F.col("_m") / F.lit(skew.bucket_rows)).cast("int").alias("_b")))


def bucket_pairs(base: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left and right sides (keys..., _i, _j, _item): one copy per bucket pair of a row's bucket."""
    b = F.coalesce("_b", F.lit(1))
    tagged = (base.join(hot, keys, "left").withColumn("_n", b)
              .withColumn("_s", F.pmod(F.xxhash64("_item"), F.col("_n")).cast("int")))
    left = tagged.select(*keys, F.col("_s").alias("_i"),
                         F.explode(F.sequence(F.col("_s"), F.col("_n") - 1)).alias("_j"), "_item")
    right = tagged.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_s"))).alias("_i"),
                          F.col("_s").alias("_j"), "_item")
    return left, right


def pair_join(df: DataFrame, keys: list[str], item: str, *, n_rows: int | None = None,
              max_group: int | None = None, skew: SkewPolicy = DEFAULT_SKEW,
              left_name: str = "item_a", right_name: str = "item_b") -> DataFrame:
    """Pairs (a, b) within equal-`keys` groups with a < b.

    Output columns: `keys...`, `left_name`, `right_name`.  `n_rows` (an
    upper bound of the row count of `df`) and `max_group` (an upper bound
    of any group's size, e.g. the number of frequent items when the items
    of a group are distinct frequent items) are used when known: if either
    proves that no group can exceed `hot_rows`, groups are not counted.
    """
    base = df.select(*keys, F.col(item).alias("_item"))
    bounds = [b for b in (n_rows, max_group) if b is not None]
    found = None
    if not bounds or min(bounds) > skew.hot_rows:
        hot = hot_groups(base, keys, skew)
        found = hot.agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum(key_bytes(hot, keys)), F.lit(0)).alias("bytes")).first()
    if found is None or not found["n"]:
        a = base.select(*keys, F.col("_item").alias(left_name))
        b = base.select(*keys, F.col("_item").alias(right_name))
        # Both sides are the same (large) table: keep a sort-merge join on one
        # shared exchange.  Without the hint AQE may turn it into a broadcast
        # when the compressed shuffle is small, collecting a table that grows
        # with the data on the driver.
        return (a.join(b.hint("merge"), keys, "inner")
                .filter(F.col(left_name) < F.col(right_name))
                .select(*keys, left_name, right_name))
    left, right = bucket_pairs(base, maybe_broadcast(hot, int(found["bytes"])), keys)
    right = right.withColumnRenamed("_item", "_other")
    joined = left.join(right.hint("merge"), keys + ["_i", "_j"], "inner")
    # Inside a bucket each pair comes in both orders, across two buckets in one.
    once = (F.col("_i") < F.col("_j")) | (F.col("_item") < F.col("_other"))
    return joined.filter(once & (F.col("_item") != F.col("_other"))).select(
        *keys, F.least("_item", "_other").alias(left_name), F.greatest("_item", "_other").alias(right_name))
