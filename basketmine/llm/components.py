"""Connected components of an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to the node's least
neighbour; small-star does the same with the smaller neighbours.  Alternating
them ends, after a number of rounds logarithmic in practice, with every node
linked to the least id of its component.  A round is two aggregates and two
joins; each round is written to shared storage, and only a row count and a
checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmine.plans.runtime import materialize, new_scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(least, "u").filter("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge (u, v); label is the least id of its component.

    Loops (u = v) give their node its own label unless it has other edges.
    Ids must not be null.  An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialize(edges.filter("u <> v").distinct(), new_scratch(spark, label))
    last = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), new_scratch(spark, label))
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return (nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("l")), "node", "left")
            .select("node", F.coalesce("l", "node").alias("label")))
