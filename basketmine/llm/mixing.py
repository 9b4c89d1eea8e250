"""Mixing sources to target weights with hash-threshold histograms.

Every row has a fixed hash.  A source's budget is met by the rows whose hash
lies up to a threshold, so the mix needs no sort: token sums per (source,
hash bucket) give the bucket the threshold falls into, only that boundary
bucket is summed again in finer buckets, and so on until the threshold row is
known.  Then a filter on the hash takes the rows.

Repeats use nested budgets.  A target T over a source of size S is split into
passes with budgets min(S, T), min(S, T - S), ...; all passes share the hash,
so the rows of a later pass are a subset of those of an earlier one.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketmine.llm.common import WORD, text_or_empty
from basketmine.plans.runtime import materialize, maybe_broadcast, new_scratch

HASH_BITS = 60          # bits of the row hash
LEVEL_BITS = 12         # 4,096 buckets per source and level
SOURCE_ROW_BYTES = 160  # a row of the source table besides the source's name
SRC, HASH, SIZE = "_mx_source", "_mx_hash", "_mx_size"


def row_hash(*cols: Column) -> Column:
    """60-bit hash of the given columns' text (null reads as empty).

    The first 15 hex digits of an MD5, which other SQL engines can compute too.
    """
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(col: str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def source_table(sized: DataFrame) -> DataFrame:
    """One row per source: its size."""
    return sized.groupBy(SRC).agg(F.sum(SIZE).cast("long").alias("source_size"))


def cycle_weights(sources: DataFrame, weights=(3, 1, 2)) -> DataFrame:
    """Weight sources in code-point order (null last) with a repeating list.

    The ranking window runs over the source table only: one short row per source.
    """
    # UTF-8 byte order is code-point order.
    order = Window.orderBy(F.col(SRC).isNull(), F.col(SRC).cast("binary"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    return sources.withColumn("weight", weight)


def targets(sources: DataFrame, budget_ratio: float, max_repeats: float) -> DataFrame:
    """Share `budget_ratio` of all sizes by weight; a target stops at `max_repeats` x its source.

    What a capped source cannot take goes to the others by weight, until none
    is above its cap.  Each turn is one small aggregate over the source table,
    which comes back as one row; a turn caps at least one more source.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    budget = float(total) * budget_ratio
    level, n_capped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        r = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.coalesce(F.count_if(over), F.lit(0)).alias("n")).first()
        if r["n"] == n_capped or r["free"] == 0:
            break
        n_capped, level = r["n"], (budget - r["held"]) / r["free"]
    level = 0.0 if level is None else level
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _budgets(sources: DataFrame, passes: int) -> DataFrame:
    """(source, pass, budget) for the passes that take a part of their source."""
    each = F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass")
    b = F.least(F.col("source_size") * 1.0,
                F.col("target") - (F.col("pass") - 1) * F.col("source_size"))
    return (sources.select(SRC, "source_size", "target", each)
            .withColumn("budget", F.greatest(b, F.lit(0.0))))


def thresholds(sized: DataFrame, sources: DataFrame, passes: int,
               source_bytes: int) -> DataFrame:
    """(source, pass, threshold): a pass takes the rows whose hash is <= threshold.

    The taken prefix of the hash order is the one whose size is nearest to
    the budget.  -1 takes nothing, 2**HASH_BITS takes all.  Rows that share the
    threshold's hash (repeats of one row) are taken together or not at all.
    """
    spark = sized.sparkSession
    budgets = _budgets(sources, passes)
    whole = (F.col("budget") >= F.col("source_size"))
    fixed = (budgets.filter(whole | (F.col("budget") <= 0))
             .select(SRC, "pass", F.when(F.col("budget") <= 0, F.lit(-1))
                     .otherwise(F.lit(1 << HASH_BITS)).cast("long").alias("threshold")))
    open_ = (budgets.filter(~whole & (F.col("budget") > 0))
             .select(SRC, "pass", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix")))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # Rows of the boundary buckets only (at first: all rows), summed per finer bucket.
        state = maybe_broadcast(open_.withColumnRenamed(SRC, "_mx_s"), source_bytes)
        inside = F.shiftright(F.col(HASH), shift + LEVEL_BITS) == F.col("prefix")
        hist = (sized.join(state, F.col(SRC).eqNullSafe(F.col("_mx_s")) & inside)
                .groupBy(SRC, "pass", "left", F.shiftright(F.col(HASH), shift).alias("bucket"))
                .agg(F.sum(SIZE).alias("n"), F.min(HASH).alias("lo"), F.max(HASH).alias("hi")))
        # At most 4,096 rows per (source, pass).
        run = Window.partitionBy(SRC, "pass").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        edge = (hist.withColumn("cum", F.sum("n").over(run))
                .filter((F.col("cum") > F.col("left")) & (F.col("cum") - F.col("n") <= F.col("left")))
                .select(SRC, "pass", (F.col("left") - (F.col("cum") - F.col("n"))).alias("left"),
                        F.col("bucket").alias("prefix"), "n", "lo", "hi"))
        edge = materialize(edge, new_scratch(spark, "mix-edge"))
        if edge.filter("lo < hi").isEmpty():   # every boundary bucket holds one hash
            break
        open_ = edge.select(SRC, "pass", "left", "prefix")
    nearer = F.col("n") - F.col("left") < F.col("left")
    found = edge.select(SRC, "pass", F.when(nearer, F.col("hi")).otherwise(F.col("hi") - 1)
                         .cast("long").alias("threshold"))
    return fixed.unionByName(found)


def _plan(sized: DataFrame, weights, budget_ratio: float, max_repeats: int) -> DataFrame:
    """One row per source: size, target and the threshold of each pass; broadcast if small."""
    spark = sized.sparkSession
    sources = materialize(cycle_weights(source_table(sized), weights),
                          new_scratch(spark, "mix-sources"))
    name = F.coalesce(F.octet_length(F.col(SRC)), F.lit(0)) + SOURCE_ROW_BYTES
    source_bytes = sources.agg(F.sum(name * max_repeats)).first()[0] or 0
    sources = targets(sources, budget_ratio, max_repeats)
    cuts = (thresholds(sized, sources, max_repeats, source_bytes)
            .groupBy(F.col(SRC).alias("_mx_s"))
            .pivot("pass", list(range(1, max_repeats + 1))).agg(F.first("threshold")))
    plan = (sources.join(cuts, F.col(SRC).eqNullSafe(F.col("_mx_s")))
            .select("_mx_s", "source_size", "target",
                    *[F.col(str(p)).alias(f"_mx_t{p}") for p in range(1, max_repeats + 1)]))
    return maybe_broadcast(materialize(plan, new_scratch(spark, "mix-plan")), source_bytes)


def _copies(max_repeats: int) -> Column:
    return sum((F.when(F.col(HASH) <= F.col(f"_mx_t{p}"), 1).otherwise(0)
                for p in range(1, max_repeats + 1)), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", keys=("doc_id", "text"),
        weights=(3, 1, 2), budget_ratio: float = 1.5, max_repeats: int = 2,
        keep=()) -> DataFrame:
    """Mix documents to target weights.

    Returns one row per input row: the `keep` columns, then `size`,
    `source_size`, `target`, `copies` (how often the mix takes the row) and
    `taken` = size * copies.  The text is read once: the narrow (source, size,
    hash) table is written to shared storage, and the histograms read that.

    Defined cases: a null text has size 0; null is a source of its own, last in
    order; rows of size 0 count for nothing but follow their hash; rows that are
    equal in all `keys` share a hash and are taken alike; a source of size 0 has
    target 0 and its rows copies 0; an empty table gives an empty result.
    """
    kept = [F.col(c).alias(f"_mx_k{i}") for i, c in enumerate(keep)]
    sized = materialize(_sized(docs, text, source, keys, kept),
                        new_scratch(docs.sparkSession, "mix-rows"))
    plan = _plan(sized, weights, budget_ratio, max_repeats)
    out = (sized.join(plan, F.col(SRC).eqNullSafe(F.col("_mx_s")))
           .withColumn("_mx_n", _copies(max_repeats)))
    return out.select(*[F.col(f"_mx_k{i}").alias(c) for i, c in enumerate(keep)],
                      F.col(SIZE).alias("size"), "source_size", "target",
                      F.col("_mx_n").alias("copies"),
                      (F.col(SIZE) * F.col("_mx_n")).alias("taken"))


def _sized(docs, text, source, keys, kept):
    return docs.select(*kept, F.col(source).alias(SRC), word_count(text).alias(SIZE),
                       row_hash(*[F.col(k) for k in keys]).alias(HASH))


def take_mix(docs: DataFrame, *, text: str = "text", source: str = "source",
             keys=("doc_id", "text"), weights=(3, 1, 2), budget_ratio: float = 1.5,
             max_repeats: int = 2) -> DataFrame:
    """The mixed documents themselves, as `mix` decides: a row comes as often as it is taken.

    Keeps the columns of `docs`.  The hash is computed again from the same
    columns, so the documents are filtered in a second scan that joins the
    small source table only.
    """
    sized = materialize(_sized(docs, text, source, keys, []),
                        new_scratch(docs.sparkSession, "mix-rows"))
    plan = _plan(sized, weights, budget_ratio, max_repeats)
    rows = docs.select(*[F.col(c).alias(f"_mx_c{i}") for i, c in enumerate(docs.columns)],
                       F.col(source).alias(SRC), row_hash(*[F.col(k) for k in keys]).alias(HASH))
    out = (rows.join(plan, F.col(SRC).eqNullSafe(F.col("_mx_s")))
           .withColumn("_mx_n", _copies(max_repeats)).filter("_mx_n > 0")
           .withColumn("_mx_i", F.explode(F.sequence(F.lit(1), F.col("_mx_n").cast("int")))))
    return out.select(*[F.col(f"_mx_c{i}").alias(c) for i, c in enumerate(docs.columns)])
