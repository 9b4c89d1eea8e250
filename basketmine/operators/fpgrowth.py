"""Second engine for the same frequent sets: Spark ML's FP-growth.

FP-growth's threshold is inclusive and relative to the number of baskets
it is given, while ours is strict and relative to N (all users).  With m
the smallest count whose support exceeds t, passing minSupport =
(m - 0.5) / M (M = number of baskets) makes FP-growth's count threshold
ceil(minSupport * M) equal to m.  Its sets are re-sorted, supports are
recomputed as count / N, and rules are derived by our rule operator (its
own confidences are computed from counts, not from supports).

Spark ML keeps the list of frequent items on the driver, so the driver holds one
short entry per member of level 1.  It yields frequent sets only: no candidates, retained baskets or per-level
statistics.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import min_count_above, support
from ..plans.runtime import materialize, new_scratch
from . import prepare as prep


def fpgrowth_itemsets(ratings: DataFrame, min_support: float, max_len: int | None = None,
                      n_users: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """(k, items, freq, support) of every set with support > min_support."""
    pairs = prep.distinct_pairs(prep.as_ratings(ratings))
    n_users = n_users or prep.count_users(pairs)
    item_freq = prep.item_support(pairs, n_users)
    frequent = prep.frequent_items(item_freq, n_users, min_support)
    spark = ratings.sparkSession
    # Read several times by the fit: on shared storage, not in executors' memory.
    baskets = materialize(prep.baskets(pairs, frequent), new_scratch(spark, "fp-baskets"))
    n_baskets = baskets.count()
    if n_baskets == 0:
        item_type = pairs.schema[prep.ITEM].dataType.simpleString()
        return spark.createDataFrame(
            [], f"k int, items array<{item_type}>, freq long, support double")
    m = min_count_above(n_users, min_support)
    fp = FPGrowth(itemsCol="items", minSupport=(m - 0.5) / n_baskets, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    sets = fp.fit(baskets).freqItemsets
    out = sets.select(F.size("items").alias("k"), F.sort_array("items").alias("items"),
                      F.col("freq").cast("long").alias("freq"))
    out = out.filter(F.col("freq") >= m)
    if max_len is not None:
        out = out.filter(F.col("k") <= max(2, max_len))
    return out.withColumn("support", support("freq", n_users))
