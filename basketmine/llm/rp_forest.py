"""Approximate nearest neighbours with a forest of random-projection trees.

A tree splits space by hyperplanes between two random points of a node, at the
median of the node's sample.  The trees are fitted on a bounded sample and grow
deeper with the table, so that a leaf stays near `LEAF_ROWS` rows; every row is
then put into one leaf of each tree.  A query walks all trees at once with one
priority queue of unvisited branches, ordered by their distance from the query,
and takes a stated number of leaves.  The rows of these leaves are ranked by
their exact cosine.

How many leaves a query takes is measured: for a bounded sample of queries the
exact neighbours are found by one scan, and the least number of leaves that holds
`recall` of them is used for all.  Vectors with neighbourhoods need few leaves;
random directions in many dimensions need most of them, and then get them.

Spark brings rows and visits together by (tree, leaf, chunk), where chunks bound
the rows of one task.  A task holds the rows of one chunk and lets its queries
pass in slices, so neither side is copied for the other's sake; it returns only
the best few rows for each query, and these are merged.  Of equal vectors only the
few with the least ids can be among a query's nearest, so copies are cut to these
before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketmine.llm.common import hash_sample
from basketmine.plans.runtime import materialize, new_scratch

TREES = 8
LEAF_ROWS = 256          # rows of a leaf that the depth of the trees aims at
MAX_DEPTH = 12           # 4,096 leaves a tree: bounds the model; leaves of larger tables are dealt into chunks
SAMPLE_ROWS = 20_000     # rows the trees are fitted on
RECALL = 0.95            # of the sampled queries' neighbours, which sets the leaves of a query
RECALL_QUERIES = 128     # queries whose exact neighbours are found to measure that
CHUNK = 4_096            # rows of a leaf in one task
SLICE = 256              # queries ranked at once
TIE = 1e-9               # scores this close to the last one are kept until the exact ranking


class Forest:
    """Hyperplanes of complete binary trees, stored by level order; picklable."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.depth, self.inner = depth, 2 ** depth - 1
        self.normals = np.zeros((trees, self.inner, dim))
        self.offsets = np.zeros((trees, self.inner))
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(self.inner):
                rows = members.pop(node)
                normal = rng.normal(size=dim)
                if len(rows) > 1:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    if not np.array_equal(a, b):
                        normal = a - b
                normal = normal / np.linalg.norm(normal)
                side = sample[rows] @ normal
                offset = float(np.median(side)) if len(rows) else 0.0
                self.normals[t, node], self.offsets[t, node] = normal, offset
                members[2 * node + 1], members[2 * node + 2] = rows[side <= offset], rows[side > offset]

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """(row, tree, node): signed distance of unit vectors from every hyperplane."""
        flat = self.normals.reshape(-1, self.normals.shape[2])
        return (unit @ flat.T).reshape(len(unit), *self.offsets.shape) - self.offsets

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf of each vector."""
        out = np.zeros((len(unit), len(self.offsets)), np.int64)
        for t in range(len(self.offsets)):
            node = out[:, t]
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, self.normals[t, node]) - self.offsets[t, node]
                node[:] = 2 * node + 1 + (side > 0)
        return out - self.inner

    def visit(self, margins: np.ndarray, held: np.ndarray, leaves: int, enough: int) -> list[tuple[int, int]]:
        """`leaves` leaves in order of distance over all trees, more while they hold under `enough` rows."""
        queue = [(0.0, t, 0) for t in range(len(self.offsets))]
        out, got = [], 0
        while queue and (len(out) < leaves or got < enough):
            far, t, node = heapq.heappop(queue)
            while node < self.inner:
                m = margins[t, node]
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near
            leaf = node - self.inner
            if held[t, leaf]:
                out.append((t, leaf))
                got += held[t, leaf]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision, in the same way whatever the block."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vec: Column) -> Column:
    """True for vectors that take part: no null, all components finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)) & \
        F.exists(vec, lambda x: x != 0)


def leaves_for(forest: Forest, held: np.ndarray, placed: DataFrame, asked: DataFrame, dim: int, k: int,
               recall: float, max_queries: int = RECALL_QUERIES) -> int:
    """The least number of leaves that holds `recall` of the exact neighbours of sampled queries."""
    sample = hash_sample(asked, F.col("id"), max_queries).select("id", "v").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1
    qids = np.array(sample["id"].to_pylist(), dtype=np.int64)
    q = _unit(_matrix(sample["v"].combine_chunks(), dim))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = np.array(b.column(0).to_pylist(), dtype=np.int64)
                scores = q @ _unit(_matrix(b.column(1), dim)).T
                scores[qids[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                of = np.repeat(np.arange(len(q)), top.shape[1])
                rows = pa.array(top.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.int32()), b.column(0).take(rows), b.column(2).take(rows),
                     pa.array(scores[of, top.reshape(-1)])], names=["q", "id", "leaves", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = (placed.mapInArrow(nearest, "q int, id long, leaves array<int>, score double")
            .filter(F.col("score") > float("-inf"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("q", "leaves").collect())             # max_queries * k rows
    wanted: dict[int, list] = {}
    for r in near:
        wanted.setdefault(r["q"], []).append(r["leaves"])
    found_at = []
    for i, each in wanted.items():
        place = {v: n for n, v in enumerate(forest.visit(forest.margins(q[i:i + 1])[0], held, held.size, 0), 1)}
        found_at += [min(place[t, leaf] for t, leaf in enumerate(leaves)) for leaves in each]
    if not found_at:
        return 1
    return sorted(found_at)[min(len(found_at), int(np.ceil(recall * len(found_at)))) - 1]


def search(index: DataFrame, queries: DataFrame, k: int = 5, *, vec_id: str = "vec_id",
           vector: str = "embedding", trees: int = TREES, depth: int | None = None,
           sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, leaves: int | None = None) -> DataFrame:
    """The k nearest rows of `index` found for every row of `queries`, by largest cosine.

    Returns query_id, rank (from 1; ties to the smaller id), vec_id and score.
    A query's own row (equal id) is never its neighbour.  `depth` is set from the
    number of rows unless given, and `leaves` (the leaves a query takes) from the
    measured recall; all leaves make the search exact.

    Defined cases: vectors null, empty, zero or holding null or non-finite
    components take no part, on either side, nor do rows with a null id or of
    another dimension than most rows; of rows equal in id and vector one counts;
    with fewer than k candidates all are returned; an empty index gives an empty
    result; other columns, whatever their names, are not read.
    """
    spark = index.sparkSession
    vec = F.col("v").cast("array<double>")

    def clean(df: DataFrame) -> DataFrame:
        return (df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
                .withColumn("v", vec).filter(F.col("id").isNotNull() & usable(F.col("v"))))

    schema = "query_id long, rank int, vec_id long, score double"
    sizes = (clean(index).groupBy(F.size("v").alias("dim")).count()
             .orderBy(F.desc("count"), "dim").limit(1).collect())
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    # Of equal vectors the k + 1 least ids (one may be the query's own) can be neighbours.
    order = Window.partitionBy("v").orderBy("id")
    rows = materialize(clean(index).filter(F.size("v") == dim).dropDuplicates(["id", "v"])
                       .withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)
                       .select("id", "v"), new_scratch(spark, "rp-rows"))
    if depth is None:
        depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(rows.count() / LEAF_ROWS)))))
    sample = hash_sample(rows, F.col("id"), sample_rows).select("v").toArrow()["v"]
    forest = Forest(_unit(_matrix(sample.combine_chunks(), dim)), trees, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = forest.leaves(_unit(_matrix(b.column(1), dim))).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(leaf.reshape(-1)), trees)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), lists.cast(pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    placed = materialize(rows.mapInArrow(place, "id long, v array<double>, leaves array<int>"),
                         new_scratch(spark, "rp-leaves"))
    in_leaf = placed.select("id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    held = np.zeros((trees, 2 ** depth), np.int64)       # trees * 2 ** depth numbers
    for r in in_leaf.groupBy("tree", "leaf").count().collect():
        held[r["tree"], r["leaf"]] = r["count"]
    asked = clean(queries).filter(F.size("v") == dim).dropDuplicates(["id", "v"])
    if leaves is None:
        leaves = leaves_for(forest, held, placed, asked, dim, k, recall)
    enough = trees * (k + 1)                             # some tree then holds k others, if there are as many

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                source, tree, leaf = [], [], []
                for i, m in enumerate(forest.margins(_unit(_matrix(b.column(1), dim)))):
                    for t, l in forest.visit(m, held, leaves, enough):
                        source.append(i)
                        tree.append(t)
                        leaf.append(l)
                take = pa.array(source, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(tree, pa.int32()),
                     pa.array(leaf, pa.int32())], names=["id", "v", "tree", "leaf"])

    visits = asked.mapInArrow(walk, "id long, v array<double>, tree int, leaf int")
    n_chunks = max(1, int(-(-held.max() // CHUNK)))
    left = in_leaf.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int"))
    right = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def rank(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        scores = _unit(q) @ _unit(x).T
        scores[qids[:, None] == ids[None, :]] = -np.inf
        last = np.sort(scores, axis=1)[:, -min(k, len(ids))]
        i, j = np.nonzero((scores >= last[:, None] - TIE) & np.isfinite(scores))
        return pa.RecordBatch.from_arrays(
            [pa.array(qids[i]), pa.array(ids[j]), pa.array(cosine(q[i], x[j]))],
            names=["query_id", "vec_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by leaf and chunk, rows before queries: hold the rows, let the queries pass."""
        key, ids, x = None, [], []
        for batch in batches:
            places = np.column_stack([batch.column(c).to_numpy() for c in (0, 1, 2, 3)])
            n = len(places)
            cuts = np.flatnonzero(np.any(places[1:] != places[:-1], axis=1)) + 1
            bounds = [0, *cuts.tolist(), n] if n else []
            for a, b in zip(bounds, bounds[1:]):
                *here, side = places[a].tolist()
                part_ids = batch.column(4).slice(a, b - a).to_numpy()
                part = _matrix(batch.column(5).slice(a, b - a), dim)
                if here != key:
                    key, ids, x = here, [], []
                if side == 0:
                    ids.append(part_ids)
                    x.append(part)
                elif ids:
                    if len(ids) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    for at in range(0, b - a, SLICE):
                        yield rank(ids[0], x[0], part_ids[at:at + SLICE], part[at:at + SLICE])

    place_of = ["tree", "leaf", "chunk"]
    both = (left.select(*place_of, F.lit(0).alias("side"), "id", "v")
            .unionByName(right.select(*place_of, F.lit(1).alias("side"), "id", "v")))
    best = (both.repartition(*place_of).sortWithinPartitions(*place_of, "side")
            .mapInArrow(meet, "query_id long, vec_id long, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
