"""Prefix classes: what a user holds of one level, grouped by the shared prefix.

A class row (user_id, prefix, exts) says that the user holds prefix + [x] for
every x of `exts`, a sorted array.  The k-sets of a user that share their first
k-1 items are one row, so the next level needs no join at all: prefix + [x] can be
extended by the members of `exts` behind x, and small rows by whole subsets of
`exts`, several levels at once.  That is a narrow step inside one stage; only
counts are shuffled, after partial aggregation.

Skew.  A row of m extensions grows into m(m-1)/2 sets.  Rows above the policy's
limit are cut into ranges of their first member, and the ranges are dealt over
the tasks, so one heavy user is the work of many.  A row itself is bounded by the
number of frequent items.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import can_broadcast
from . import prepare as prep
from .pairs import DEFAULT_SKEW, SkewPolicy

USER, ITEM = prep.USER, prep.ITEM
MAX_AHEAD = 6            # levels counted in one job at most
ROW_SETS = 200           # sets of one row that are built as one value; the fold scans them once per extension


def first_classes(pairs: DataFrame) -> DataFrame:
    """Distinct (user, frequent item) -> one class per user, with the empty prefix."""
    item = pairs.schema[ITEM].dataType.simpleString()
    return (pairs.groupBy(USER).agg(F.sort_array(F.collect_list(ITEM)).alias("exts"))
            .select(USER, F.array().cast(f"array<{item}>").alias("prefix"), "exts"))


def deal_hot(classes: DataFrame, largest: int, skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Adds the range [lo, hi) of first members a row stands for; rows above the limit are cut and dealt.

    `largest` is the size of the largest `exts`; below the limit nothing is added to the plan.
    """
    m = F.size("exts")
    whole = classes.withColumn("lo", F.lit(0)).withColumn("hi", m)
    if largest <= skew.hot_rows:
        return whole
    step = F.greatest(F.lit(1), F.floor(F.lit(skew.max_pairs_per_task) / m)).cast("int")
    ranges = F.explode(F.sequence(F.lit(0), m - 1, step)).alias("lo")
    hot = (classes.filter(m > skew.hot_rows).select(*classes.columns, ranges)
           .withColumn("hi", F.least(F.col("lo") + step, m)))
    # A stated number of partitions: few bytes that mean much work must not be put together again.
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.filter(m <= skew.hot_rows).unionByName(hot.repartition(tasks, USER, "prefix", "lo"))


def grow(classes: DataFrame, largest: int = 0, skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Classes one item longer, not yet filtered: prefix + [x] with the members of `exts` behind x."""
    each = (deal_hot(classes, largest, skew).filter("size(exts) > 1")
            .selectExpr(USER, "prefix", "exts", "lo", "posexplode(slice(exts, lo + 1, hi - lo)) as (i, x)"))
    return (each.filter("lo + i + 2 <= size(exts)")
            .selectExpr(USER, "concat(prefix, array(x)) as prefix",
                        "slice(exts, lo + i + 2, size(exts)) as exts"))


def keep_frequent(grown: DataFrame, level_table: DataFrame, n_bytes: int) -> DataFrame:
    """Grown classes with the extensions whose set is in `level_table` (prefix, last); empty rows go.

    The level table is broadcast only within its measured bound; beyond that the
    join shuffles by prefix, and AQE splits a prefix that many users hold.
    """
    known = level_table.groupBy("prefix").agg(F.collect_list("last").alias("_known"))
    if can_broadcast(grown.sparkSession, n_bytes):
        known = F.broadcast(known)
    return (grown.join(known, "prefix")
            .select(USER, "prefix", F.array_intersect("exts", "_known").alias("exts"))
            .filter(F.size("exts") > 0))


def held(classes: DataFrame) -> DataFrame:
    """(user_id, prefix, last): one row per user and set."""
    return classes.select(USER, "prefix", F.explode("exts").alias("last"))


def _counted(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("items").agg(F.count(F.lit(1)).alias("freq"))
            .selectExpr("size(items) as k", "slice(items, 1, size(items) - 1) as prefix",
                        "element_at(items, -1) as last", "items", "freq"))


def count_next(classes: DataFrame, largest: int = 0, skew: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """(k, prefix, last, items, freq) of all sets of the next level that some user holds."""
    return _counted(held(grow(classes, largest, skew)).selectExpr("concat(prefix, array(last)) as items"))


def count_ahead(classes: DataFrame, ahead: int) -> DataFrame:
    """`count_next` for the next `ahead` levels, of small classes, by one aggregate keyed by the set.

    A row's sets are built by one fold over its extensions: each joins every subset so far.
    """
    item = classes.schema["exts"].dataType.elementType.simpleString()
    subsets = (f"aggregate(exts, array(cast(array() as array<{item}>)), (acc, x) -> concat(acc, "
               f"transform(filter(acc, s -> size(s) <= {ahead}), s -> concat(s, array(x)))))")
    return _counted(classes.filter("size(exts) > 1")
                    .selectExpr("prefix", f"explode(filter({subsets}, s -> size(s) > 1)) as s")
                    .selectExpr("concat(prefix, s) as items"))


def size_metrics() -> list[Column]:
    """Aggregates to be taken while class rows are written: their number, largest size, and growth.

    w<j> is the number of j-subsets of the rows' extensions, as a double.
    """
    out = ["count(1) as rows", "coalesce(max(size(exts)), 0) as largest", "count_if(size(exts) > 1) as growing"]
    for j in range(2, MAX_AHEAD + 2):
        product = " * ".join(f"double(greatest(size(exts) - {i}, 0)) / {float(i + 1)}D" for i in range(j))
        out.append(f"coalesce(sum({product}), 0D) as w{j}")
    return [F.expr(e) for e in out]


def levels_ahead(metrics: dict, budget_rows: int) -> int:
    """How many levels to count in one job.

    As many as cost no more than the next level again, or `budget_rows`, while the
    sets of a single row stay few enough to be one value (ROW_SETS).
    """
    total, row, best = 0.0, 0, 1
    for ahead in range(1, MAX_AHEAD + 1):
        total += metrics[f"w{ahead + 1}"]
        row += math.comb(metrics["largest"], ahead + 1)
        if total <= max(budget_rows, 2 * metrics["w2"]) and row <= ROW_SETS:
            best = ahead
    return best
