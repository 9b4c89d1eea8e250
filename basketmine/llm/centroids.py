"""Centroid clustering on integers with an incrementally updated distance matrix.

Each vector keeps its exact integer dot product with every centroid next to its
components.  When a centroid moves, only its nonzero component changes d touch
the matrix: dot += sum over d of d[j] * v[j].  The squared distance is
v.v - 2 dot + c.c, so the nearest centroid follows from the kept products; a
centroid that did not move costs nothing.  New centroids come from sums that are
updated the same way, by the vectors that changed their cluster.

All numbers are integers, so results do not depend on partitioning or on the
order of additions.  A round reads the kept table, writes the next one to shared
storage, and frees the one before; only the centroids and the sums of the moved
vectors, clusters x components numbers, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmine.plans.runtime import delete_path, materialize, new_scratch

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
# Components beyond this leave no room for an exact squared distance in 64 bits.
MAX_COMPONENT = 1 << 27


def integer_vector(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless there are `dim`, none null, non-finite or too large."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) * scale < MAX_COMPONENT), F.lit(False)))
    return F.when((F.size(vector) == dim) & inside, whole)


def seed_order(vec_id: Column) -> Column:
    """Lowercase hex sha256 of `1:<vec_id>`; null for a null id."""
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256)


@dataclass
class Clustering:
    state: DataFrame               # vec_id, v, dots, vv, before, cluster, distance
    centroids: list[list[int]]
    folder: str                    # holds the state; delete it when done

    def digest(self, k: int) -> str:
        """Lowercase hex sha256 of a centroid's components, as decimal integers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.centroids[k])).encode()).hexdigest()


def _assign(state: DataFrame, changes: list[list[tuple[int, int]]], centroids: list[list[int]]) -> DataFrame:
    """Adds the centroids' component changes to the kept products, then takes the nearest centroid."""
    moved = [(k, np.array([j for j, _ in c]), np.array([x for _, x in c], dtype=np.int64))
             for k, c in enumerate(changes) if c]
    cc = np.array([sum(x * x for x in c) for c in centroids], dtype=np.int64)
    n_dim, n_clusters = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dim)
            dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_clusters).copy()
            vv = batch.column("vv").to_numpy(zero_copy_only=False)
            for k, at, change in moved:
                dots[:, k] += v[:, at] @ change
            rest = cc[None, :] - 2 * dots
            cluster = rest.argmin(axis=1)            # the first of equals
            near = vv + rest[np.arange(len(v)), cluster]
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * n_clusters)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"),
                 pa.ListArray.from_arrays(ends, pa.array(dots.reshape(-1))), batch.column("vv"),
                 batch.column("cluster"), pa.array(cluster.astype(np.int32)), pa.array(near)],
                names=["vec_id", "v", "dots", "vv", "before", "cluster", "distance"])

    id_type = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {id_type}, v array<bigint>, dots array<bigint>, vv bigint, "
                                 "before int, cluster int, distance bigint")


def _move_sums(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Takes the vectors that changed their cluster out of the old sum and into the new one.

    Tasks hand on one row of sums per batch and cluster.
    """
    n_dim, n_clusters = len(sums[0]), len(counts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dim)
            total, n = np.zeros((n_clusters, n_dim), np.int64), np.zeros(n_clusters, np.int64)
            for name, sign in (("cluster", 1), ("before", -1)):
                side = batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for k in range(n_clusters):
                    rows = side == k
                    total[k] += sign * v[rows].sum(axis=0)
                    n[k] += sign * int(rows.sum())
            ends = pa.array(np.arange(n_clusters + 1, dtype=np.int32) * (n_dim + 1))
            flat = np.column_stack([n, total]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_clusters, dtype=np.int32)),
                                              pa.ListArray.from_arrays(ends, pa.array(flat))], names=["k", "s"])

    moved = state.filter(~F.col("cluster").eqNullSafe(F.col("before"))).select("v", "before", "cluster")
    per = (moved.mapInArrow(partial, "k int, s array<bigint>").select("k", F.posexplode("s").alias("j", "x"))
           .groupBy("k", "j").agg(F.sum("x").alias("x")))
    for row in per.collect():                        # clusters x (components + 1) rows
        if row["j"]:
            sums[row["k"]][row["j"] - 1] += row["x"]
        else:
            counts[row["k"]] += row["x"]


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding",
            clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> Clustering | None:
    """Lloyd rounds from the `clusters` vectors of least seed hash; None without a usable vector.

    Each round assigns every vector to its nearest centroid (ties: the smaller
    number) and moves every non-empty centroid to the floor of its mean; a last
    assignment follows.

    Defined cases: a vector that is null, of another length, or holds null,
    non-finite or too large components (MAX_COMPONENT) takes no part; fewer
    vectors than `clusters` give fewer centroids; repeated rows are vectors of
    their own, and of equal ids those with smaller components come first as
    seeds; a vector with a null id is clustered but never a seed (without any id
    there is no seed and no clustering); other columns are left out.
    """
    spark = vectors.sparkSession
    folder = new_scratch(spark, "centroids")
    kept = (vectors.select(F.col(vec_id).alias("vec_id"), integer_vector(F.col(vector), dim, scale).alias("v"))
            .filter("v IS NOT NULL"))
    seeds = (kept.filter("vec_id IS NOT NULL").select(seed_order(F.col("vec_id")).alias("h"), "v")
             .orderBy("h", "v").limit(clusters).collect())       # `clusters` rows
    if not seeds:
        return None
    centroids = [list(r["v"]) for r in seeds]
    zeros = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    state = kept.select("vec_id", "v", zeros.alias("dots"),
                        F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("vv"),
                        F.lit(None).cast("int").alias("cluster"))
    # Products start at zero, so the first change of a centroid is all of it.
    changes = [[(j, x) for j, x in enumerate(c) if x] for c in centroids]
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    for r in range(rounds + 1):
        state = materialize(_assign(state, changes, centroids), f"{folder}/round={r}")
        if r:
            delete_path(spark, f"{folder}/round={r - 1}")
        if r == rounds:
            break
        _move_sums(state, sums, counts)
        for k, old in enumerate(centroids):
            new = [s // counts[k] for s in sums[k]] if counts[k] else old
            changes[k] = [(j, b - a) for j, (a, b) in enumerate(zip(old, new)) if a != b]
            centroids[k] = new
    return Clustering(state, centroids, folder)


def labels(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Inertias are sums of distances; one beyond 64 bits is null.
    """
    spark = found.state.sparkSession
    per = {r["cluster"]: int(r["s"]) for r in found.state.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}   # one row per cluster
    total = sum(per.values())
    fits = {k: (s if s < 1 << 63 else None) for k, s in per.items()}
    rows = [(k, s, total if total < 1 << 63 else None, found.digest(k)) for k, s in fits.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
