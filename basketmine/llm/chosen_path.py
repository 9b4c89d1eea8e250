"""Set similarity join on word shingles by chosen paths.

Every set keeps a pool of its tokens: token t of set x is in it if a hash that
all sets share is below POOL / (threshold * |x|).  Two sets with Jaccard
similarity >= threshold have POOL or more pool tokens in common on average.  In
run r, a set chooses from its pool RATE such tokens on average, by a hash of
(r, t), and joins the bucket of each.  A bucket too large for brute force is
split: each of its sets chooses again, BELOW tokens on average, by a hash of
(path, t), where the path names the bucket.  Sets that share little of their
tokens part on the way, at every level anew, while similar ones go on sharing a
path.  After LEVELS splits a bucket is replaced by its parts only if these need
far fewer comparisons.  Runs are repeated until the target recall, which counts
the pool and all levels.

Every pair of a bucket that may be similar by size is compared exactly, and a
pair that meets in several buckets is counted only in the least of them, so no
list of pairs is ever made: a bucket returns one row per set, with its links and
the root of its local group.  Equal sets are one node from the start, with the
number of their documents.  Buckets too large for one task are compared block
against block.

Spark shuffles small (node, bucket) rows until the buckets are known, then the
bucket ids of the nodes to find who has a pair to compare in which bucket.  Only
then are sets shuffled, and only to those buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmine.llm import components
from basketmine.llm.common import WordHash
from basketmine.llm.shingles import mix, set_id, shingle_set
from basketmine.plans.runtime import materialize, new_scratch

THRESHOLD = 0.8
RECALL = 0.9999          # target for a pair just at the threshold
POOL = 64.0              # mean number of pool tokens that such a pair shares
RATE = 2.0               # ... of them chosen in a run
BELOW = 1.2              # ... and chosen again where a bucket is split
LEVELS = 3               # splits of a large bucket
SMALL = 100              # buckets up to this size are not split further
SPLIT_GAIN = 0.5         # a bucket is split if its parts need less than this share of the comparisons
BLOCK = 1_000            # sets of one side of a comparison task
SET_BYTES = 6            # bytes kept of a token's hash when sets are compared


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is found with probability `recall`.

    Its sets share k pool tokens, k Poisson with mean POOL.  A run finds them if
    one of the tokens is chosen and, should every bucket be split, some path
    goes on through all levels; given k, paths and runs are independent.
    """
    ks = np.arange(int(POOL + 12 * math.sqrt(POOL)))
    chance = np.exp([k * math.log(POOL) - POOL - math.lgamma(k + 1) for k in ks])
    lives = np.ones(len(ks))
    for _ in range(levels):
        lives = 1 - (1 - lives * BELOW / POOL) ** ks
    miss = (1 - lives * RATE / POOL) ** ks
    for runs in range(1, 200):
        if (chance * miss ** runs).sum() <= 1 - recall:
            return runs
    raise ValueError("recall too close to 1")


def _below(hashes: np.ndarray, share: float) -> np.ndarray:
    """Which hashes lie in the least `share` of all."""
    return hashes <= np.uint64(min(int(share * 2.0 ** 64), 2 ** 64 - 1))


def _sample(s: np.ndarray, seeds: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The pool of a set (`seeds[0]`) and the tokens chosen from it in every run (the other seeds)."""
    size = threshold * len(s)
    pool = s[_below(mix(s ^ seeds[0]), min(1.0, POOL / size))]
    drawn = _below(mix(pool[None, :] ^ seeds[1:, None]), RATE / min(POOL, max(RATE, size)))
    return pool, [pool[row] for row in drawn]


def _sketch(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(_cp_id, _cp_text hash, node, n, lists, pool): set id, set size, chosen tokens of every run, pool.

    Pool tokens are cut to 32 bits: they only part sets that share a bucket.
    """
    seeds = mix(np.arange(1, runs + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    src = docs.select("_cp_id", "_cp_hash", F.col("_cp_text").cast("binary").alias("_cp_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            nodes, sizes, tokens, ends, outer = [], [], [], [0], [0]
            pools, stops = [], [0]
            for data in batch.column(2).to_pylist():
                s = shingle_set(data, cache)
                nodes.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                pool, lists = _sample(s, seeds, threshold) if len(s) else (s, [])
                for chosen in lists:
                    tokens.append(chosen)
                    ends.append(ends[-1] + len(chosen))
                outer.append(len(ends) - 1)
                pools.append(pool.astype(np.uint32).view(np.int32))
                stops.append(stops[-1] + len(pool))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(flat, pa.int64())))
            pool = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(
                np.concatenate(pools) if pools else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()),
                 pa.array(sizes, pa.int32()), lists, pool],
                names=["_cp_id", "_cp_hash", "node", "n", "lists", "pool"])

    id_type = src.schema["_cp_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_cp_id {id_type}, _cp_hash long, node long, n int, "
                               "lists array<array<long>>, pool array<int>")


def _split(large: DataFrame, pools: DataFrame, threshold: float) -> DataFrame:
    """(node, parent, bucket, c): the parts, of 2 nodes or more, of the buckets of `large` (node, bucket)."""
    size = F.lit(threshold) * F.col("n")
    limit = F.lit(2.0 ** 63) * F.least(F.lit(1.0), F.lit(BELOW) / F.least(F.lit(POOL), size))
    # One row per node meets its pool.
    mine = large.groupBy("node").agg(F.collect_list("bucket").alias("mine"))
    kids = (mine.join(pools, "node")
            .select("node", "pool", limit.alias("limit"), F.explode("mine").alias("parent"))
            .select("node", "parent", F.explode(F.filter(
                "pool", lambda t: F.xxhash64("parent", t).bitwiseAND(2 ** 63 - 1) < F.col("limit"))).alias("t"))
            .select("node", "parent", F.xxhash64(F.lit("part"), "parent", "t").alias("bucket")))
    sizes = kids.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return kids.join(sizes, "bucket").select("node", "parent", "bucket", "c")


def _buckets(reps: DataFrame, small: int, levels: int, threshold: float) -> DataFrame:
    """(node, bucket): the buckets to compare; every one holds 2 nodes or more."""
    spark = reps.sparkSession
    rows = (reps.select("node", F.posexplode("lists").alias("r", "ts"))
            .select("node", "r", F.explode("ts").alias("t"))
            .select("node", F.xxhash64("r", "t").alias("bucket")))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    level = [materialize(rows.join(counts, "bucket").select("node", "bucket", "c"), new_scratch(spark, "cp-first"))]
    pools = None                                     # of the nodes that any large bucket holds
    for _ in range(levels):
        large = level[-1].filter(F.col("c") > small)
        if large.isEmpty():
            break
        if pools is None:
            pools = materialize(reps.select("node", "n", "pool").join(large.select("node").distinct(), "node", "left_semi"),
                                new_scratch(spark, "cp-pools"))
        level.append(materialize(_split(large, pools, threshold), new_scratch(spark, "cp-parts")))
    # From the last level up: what a bucket costs, split wherever that gains enough.
    square = F.col("c").cast("double") * F.col("c")
    gains, below = [], None
    for depth in reversed(range(len(level))):
        bucket = level[depth].groupBy("bucket").agg(F.first("c").alias("c"), *(
            [F.first("parent").alias("parent")] if depth else []))
        if below is not None:
            parts = below.groupBy(F.col("parent").alias("bucket")).agg(F.sum("cost").alias("cost"))
            gain = materialize(
                bucket.filter(F.col("c") > small).join(parts, "bucket", "left")
                .select("bucket", F.coalesce("cost", F.lit(0.0)).alias("cost"), square.alias("whole"))
                .filter(F.col("cost") < SPLIT_GAIN * F.col("whole")).select("bucket", "cost"),
                new_scratch(spark, "cp-gain"))
            gains.insert(0, gain)
            bucket = bucket.join(gain, "bucket", "left")
        else:
            bucket = bucket.withColumn("cost", F.lit(None).cast("double"))
        below = bucket.withColumn("cost", F.coalesce("cost", square)) if depth else None
    # From the first level down: buckets that are not split, of those reached.
    final, live = None, level[0].select("node", "bucket")
    for depth in range(len(level)):
        if depth < len(gains):
            split = gains[depth].select("bucket")
            stay = live.join(split, "bucket", "left_anti")
            reached = live.select("bucket").distinct().join(split, "bucket", "left_semi")
            live = (level[depth + 1].join(reached.withColumnRenamed("bucket", "parent"), "parent", "left_semi")
                    .select("node", "bucket"))
        else:
            stay = live
        final = stay if final is None else final.unionByName(stay)
    final = materialize(final, new_scratch(spark, "cp-buckets"))
    # Buckets with the same members need one comparison.
    members = final.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    keep = members.groupBy("c", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return (final.join(keep, "bucket", "left_semi")
            .join(members.select("bucket", "c"), "bucket").select("node", "bucket", "c"))


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """`needed` with `tokens`: the shortened token hashes of each node's set."""
    rows = docs.join(needed, F.col("_cp_id").eqNullSafe(F.col("k_id"))
                     & (F.col("_cp_hash") == F.col("k_hash")))
    src = rows.select("node", "w", "ids", "places", F.col("_cp_text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            packed = [shingle_set(d, cache).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()
                      for d in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:4] + [pa.array(packed, pa.binary())],
                                             names=["node", "w", "ids", "places", "tokens"])

    return src.mapInArrow(run, "node long, w long, ids array<long>, "
                               "places array<struct<bucket:long,i:int,j:int,side:int>>, tokens binary")


def open_pairs(sizes: np.ndarray, far: np.ndarray | None, before: list[np.ndarray],
               threshold: float) -> np.ndarray:
    """Matrix of the pairs of a task that are to be compared there.

    `sizes` are those of the sets; `far` tells the two blocks apart, where a pair
    must lie across them; `before` holds each node's buckets that come before this
    one: a pair that shares one of those is compared there.
    """
    ok = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(ok, False)
    if far is not None:
        ok &= far[:, None] != far[None, :]
    return ok & (_shared(before) == 0) if ok.any() else ok


def compare(sets: list[np.ndarray], far: np.ndarray | None, before: list[np.ndarray],
            threshold: float) -> np.ndarray:
    """Matrix of the linked pairs of a task."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ok = open_pairs(sizes, far, before, threshold)
    if not ok.any():
        return ok
    # Of the two sets of an open pair, the one with more of them is multiplied with all: few open
    # pairs, or those of few sets, need few rows of the product.
    order = np.argsort(ok.sum(axis=1), kind="stable")
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    rows = np.flatnonzero((ok & (rank[:, None] > rank[None, :])).any(axis=1))
    inter = _shared(sets, rows)
    near = inter / np.maximum(sizes[rows, None] + sizes[None, :] - inter, 1) >= threshold
    linked = np.zeros_like(ok)
    linked[rows] = ok[rows] & near
    return linked | linked.T


def _shared(sets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the intersections of all (or some) sets with all, by products of membership matrices
    over slices of the tokens."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    out = np.zeros((m if rows is None else len(rows), m))
    if not len(owner):
        return out
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    common = count > 1                               # a token of one set meets nothing
    place = np.cumsum(common) - 1
    keep = common[column]
    owner, column, width = owner[keep], place[column[keep]], int(common.sum())
    step = max(64, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((m, min(step, width - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1.0
        out += (x if rows is None else x[rows]) @ x.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the least index of its connected group."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _by_task(rows: DataFrame, finish, schema: str) -> DataFrame:
    """Apply `finish(bucket, i, j, rows of the task)`, a list of tuples, to the tasks of `rows`.

    `rows` starts with bucket, i, j, side, node, ids and is grouped by the first three; a node
    comes once to a task (repeated rows of one document are left out).
    """
    types = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]

    def pack(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(col, types[kind]) for col, (_, kind) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, {}, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for b, i, j, side, node, *rest in zip(*cols):
                if (b, i, j) != key:
                    out += finish(*key, group) if len(group) > 1 else []
                    key, group = (b, i, j), {}
                group.setdefault(node, (side, *rest))
            if len(out) > 10_000:
                yield pack(out)
                out = []
        out += finish(*key, group) if len(group) > 1 else []
        if out:
            yield pack(out)

    return (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(run, schema))


def _earlier(ids: list[list[int]], bucket: int) -> list[np.ndarray]:
    return [np.array([b for b in own if b < bucket], dtype=np.int64) for own in ids]


def _far(sides: list[int], i: int, j: int) -> np.ndarray | None:
    return None if i == j else np.array(sides) == j


def _places(nodes: DataFrame, block: int, threshold: float) -> DataFrame:
    """(node, bucket, i, j, side): the tasks in which a node of `nodes` (node, n, buckets) has a pair to compare.

    A bucket of up to 2 * block nodes is one task.  A larger one is dealt into
    ceil(c / block) blocks, and each pair of blocks is a task.
    """
    rows = (nodes.select("node", "n", F.transform("buckets", lambda x: x["b"]).alias("ids"),
                         F.explode("buckets").alias("x"))
            .select("node", "n", "ids", F.col("x.b").alias("bucket"),
                    F.when(F.col("x.c") <= 2 * block, 1).otherwise(F.ceil(F.col("x.c") / block))
                    .cast("int").alias("g")))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                       "side", "node", "ids", "n")

    def finish(bucket, i, j, group):
        sides, ids, sizes = zip(*group.values())
        some = open_pairs(np.array(sizes), _far(sides, i, j), _earlier(ids, bucket), threshold).any(axis=1)
        return [(node, bucket, i, j, side) for node, side, yes in zip(group, sides, some) if yes]

    return _by_task(rows, finish, "node long, bucket long, i int, j int, side int")


def _compare_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): for each task's linked nodes their weighted links and local root."""
    rows = (sets.select("node", "w", "ids", "tokens", F.explode("places").alias("p"))
            .select("p.bucket", "p.i", "p.j", "p.side", "node", "ids", "w", "tokens"))

    def unpack(tokens: bytes) -> np.ndarray:
        raw = np.frombuffer(tokens, np.uint8).reshape(-1, SET_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :SET_BYTES] = raw
        return wide.view(np.uint64).reshape(-1)

    def finish(bucket, i, j, group):
        # Ordered by id, so that a root is the least id of its group.
        nodes = sorted(group)
        sides, ids, weights, tokens = zip(*(group[n] for n in nodes))
        linked = compare([unpack(t) for t in tokens], _far(sides, i, j), _earlier(ids, bucket), threshold)
        links, root = linked @ np.array(weights, dtype=np.int64), _roots(linked)
        return [(nodes[k], int(links[k]), nodes[root[k]]) for k in np.flatnonzero(linked.any(axis=1))]

    return _by_task(rows, finish, "node long, links long, root long")


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL,
         levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """Link all documents whose sets of 5-word shingles have Jaccard similarity >= threshold.

    One row per input row: doc_id, text_hash (of the text), class_id (the
    least doc_id of its connected group), n_links (other documents at or above the
    threshold, copies counted) and first (true for one row of each group).

    Defined cases: a text without words (null, empty, white space) has no links
    and is a group of its own; a text of fewer than five words is one shingle;
    rows equal in id and text are copies of one another, and one of them is
    first; null ids count as the largest; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = runs_for(recall, levels)
    src = docs.select(F.col(doc_id).alias("_cp_id"), F.xxhash64(text).alias("_cp_hash"),
                      F.col(text).alias("_cp_text"))
    sketches = materialize(_sketch(src, threshold, runs), new_scratch(spark, "cp-sketch"))
    order = F.struct(F.col("_cp_id").isNull().alias("nul"), F.col("_cp_id").alias("id"),
                     F.col("_cp_hash").alias("h"))
    reps = materialize(
        sketches.filter("node IS NOT NULL").groupBy("node")
        .agg(F.count(F.lit(1)).alias("w"), F.min(order).alias("key"), F.first("n").alias("n"),
             F.first("lists").alias("lists"), F.first("pool").alias("pool")), new_scratch(spark, "cp-nodes"))
    final = _buckets(reps, small, levels, threshold)
    mine = final.groupBy("node").agg(F.collect_list(F.struct(F.col("bucket").alias("b"), "c")).alias("buckets"))
    nodes = materialize(mine.join(reps.select("node", "n", "w", "key"), "node"), new_scratch(spark, "cp-mine"))
    places = (_places(nodes.select("node", "n", "buckets"), block, threshold).groupBy("node")
              .agg(F.collect_list(F.struct("bucket", "i", "j", "side")).alias("places")))
    needed = materialize(
        nodes.join(places, "node")
        .select("node", "w", F.transform("buckets", lambda x: x["b"]).alias("ids"), "places",
                F.col("key.id").alias("k_id"), F.col("key.h").alias("k_hash")), new_scratch(spark, "cp-needed"))
    found = materialize(_compare_buckets(_sets(src, needed), threshold), new_scratch(spark, "cp-links"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components.connected(found.select(F.col("node").alias("u"), F.col("root").alias("v")),
                                  "cp-groups")
    joined = (reps.select("node", "w", "key").join(links, "node", "left").join(groups, "node", "left")
              .withColumn("label", F.coalesce("label", "node")))
    joined = materialize(joined, new_scratch(spark, "cp-joined"))
    least = joined.groupBy("label").agg(F.min("key").alias("least"))
    verdict = joined.join(least, "label").select(
        "node", "least", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketches.select("_cp_id", "_cp_hash", "node").join(verdict, "node", "left")
    mine = F.col("_cp_id").eqNullSafe(F.col("least.id")) & (F.col("_cp_hash") == F.col("least.h"))
    return out.select(
        F.col("_cp_id").alias("doc_id"), F.col("_cp_hash").alias("text_hash"),
        F.when(F.col("node").isNull(), F.col("_cp_id")).otherwise(F.col("least.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | mine).alias("first"))
