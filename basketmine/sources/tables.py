"""(user, item) relations derived from the warehouse tables.

Each fixture is a plain projection/join of the given parquet tables; only
the two key columns are read (column pruning reaches the scan) and the
join of lineitem with its dimension is left to Catalyst/AQE, which
broadcasts the dimension when it is small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _line_part(spark, sf_dir, attr: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", attr)
    return (li.join(part, li.l_partkey == part.p_partkey, "inner")
            .select(F.col("l_orderkey").alias("user_id"), F.col(attr).alias("item_id")))


def order_types(spark, sf_dir) -> DataFrame:
    """order -> part type."""
    return _line_part(spark, sf_dir, "p_type")


def order_brands(spark, sf_dir) -> DataFrame:
    """order -> part brand."""
    return _line_part(spark, sf_dir, "p_brand")


def _line_order(spark, sf_dir, item_col: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", item_col)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
            .select(F.col("o_custkey").alias("user_id"), F.col(item_col).alias("item_id")))


def customer_suppliers(spark, sf_dir) -> DataFrame:
    """customer -> supplier."""
    return _line_order(spark, sf_dir, "l_suppkey")


def customer_parts(spark, sf_dir) -> DataFrame:
    """customer -> part."""
    return _line_order(spark, sf_dir, "l_partkey")


def user_days(spark, sf_dir) -> DataFrame:
    """event user -> day of year of the event."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts")
    return ev.select("user_id", F.dayofyear("ts").alias("item_id"))


def part_order_ratings(spark, sf_dir) -> DataFrame:
    """Rating rows in the reference's shape: one per line item, the part as
    the rated item, the order as the user, line number as the star value
    and ship date as the rating date."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("user_id"),
                     F.col("l_linenumber").alias("rating"),
                     F.to_date("l_shipdate").alias("rated_on"),
                     "l_returnflag", "l_linestatus")
