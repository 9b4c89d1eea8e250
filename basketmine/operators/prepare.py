"""Level-0/1 operators: ID bounds, distinct users, item support, baskets.

Input is any DataFrame with a user and an item column (names configurable),
e.g. the output of a rating-block reader or a join of warehouse tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import is_frequent, support

USER = "user_id"
ITEM = "item_id"


def as_ratings(df: DataFrame, user_col: str = USER, item_col: str = ITEM) -> DataFrame:
    """(user_id, item_id) projection without null ids."""
    return (df.select(F.col(user_col).alias(USER), F.col(item_col).alias(ITEM))
            .filter(F.col(USER).isNotNull() & F.col(ITEM).isNotNull()))


def bounded_ratings(ratings: DataFrame, max_item=None, max_user=None,
                    strict_user: bool = False) -> DataFrame:
    """ID bounds (P3-P5): item <= max_item; user <= max_user, or < if strict.

    The reference counts N with `<=` but builds baskets and level 1 with
    `<` (strict_user=True reproduces that second filter).
    """
    out = ratings
    if max_item is not None:
        out = out.filter(F.col(ITEM) <= F.lit(max_item))
    if max_user is not None:
        cond = F.col(USER) < F.lit(max_user) if strict_user else F.col(USER) <= F.lit(max_user)
        out = out.filter(cond)
    return out


def distinct_user_count(ratings: DataFrame) -> DataFrame:
    """One row `n_users` = count(distinct user) (A1)."""
    return ratings.agg(F.count_distinct(USER).alias("n_users"))


def count_users(ratings: DataFrame) -> int:
    """N as a driver-side integer; aborts when N <= 0 (Q16)."""
    n = distinct_user_count(ratings).first()["n_users"]
    if not n or n <= 0:
        raise ValueError("no users in the input (N <= 0)")
    return int(n)


def distinct_pairs(ratings: DataFrame) -> DataFrame:
    """Distinct (user, item): the basket relation in long form."""
    return ratings.select(USER, ITEM).distinct()


def item_support(ratings: DataFrame, n_users: int, count: str = "distinct") -> DataFrame:
    """(item_id, freq, support) per item (A2, A3).

    count="distinct" counts distinct users per item (decision B2);
    count="rows" counts rating rows, as the reference's level 1 does.
    A plain groupBy: Spark aggregates partially before the shuffle, so a
    very popular item costs one partial row per input partition.
    """
    src = ratings if count == "rows" else ratings.select(USER, ITEM).distinct()
    if count not in ("rows", "distinct"):
        raise ValueError("count must be 'distinct' or 'rows'")
    return (src.groupBy(ITEM).agg(F.count(F.lit(1)).alias("freq"))
            .withColumn("support", support("freq", n_users)))


def frequent_items(supports: DataFrame, n_users: int, min_support: float) -> DataFrame:
    """Items with support > t."""
    return supports.filter(is_frequent("freq", n_users, min_support))


def baskets(pairs: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """user -> sorted set of (frequent) items (A4).

    Infrequent items are dropped before grouping (semi-join against the
    frequent-item table).  A basket holds at most one entry per frequent
    item, so its size is bounded by the size of level 1.
    """
    src = pairs
    if frequent is not None:
        src = src.join(frequent.select(ITEM), ITEM, "left_semi")
    return src.groupBy(USER).agg(F.sort_array(F.collect_set(ITEM)).alias("items"))
