"""Centroid clustering by sort-means, in whole numbers.

Vectors of `DIMENSIONS` components, none null or non-finite, become integers
floor(256 x). The first centroids are the vectors of least sha256 of `2:<vec_id>`.
In each round the other centroids are ordered by distance from each centroid, once;
a vector scans the order of the centroid that it had before, and stops at the first
centroid that lies strictly beyond twice its distance from that one: by the triangle
inequality no such centroid is nearer, nor as near. Squares are compared (four times
the square), so all is exact, and ties go to the smaller number.

Spark deals out the vectors. A task assigns its vectors in batches and adds their
components up by centroid; a round writes the vectors with their centroids and the
sums of each batch, and only the sums, one row a centroid, reach the driver, which
holds k centroids and their k x k distances and sends them out again.

Other vectors give no rows. A null vec_id is clustered like others but never a first
centroid. Repeated rows are vectors of their own; equal ids tie in the order of their
components. Components beyond 2^27 (after scaling) count as that, so that distances
fit in a long; sums of distances stop at the largest long. Fewer vectors than k make fewer centroids, no vectors no rows. An empty
centroid stays as it is. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_scratch, materialize

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
WIDEST = 1 << 27
#: Vectors that are assigned at once.
BLOCK = 4096


def whole(vectors: DataFrame, column: str = "embedding", size: int = DIMENSIONS) -> DataFrame:
    """vec_id and v, the integers of each vector that has `size` finite components."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-WIDEST)), F.least(F.lit(float(WIDEST)), c * SCALE))).cast("int"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, between: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and the squared distance, starting from the centroids of `before`."""
    best = before.copy()
    least = square(x, centroids[before])
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = least[rows].copy()
        # Farthest first: those that still scan are always a leading part.
        by = np.argsort(-own, kind="stable")
        rows, own = rows[by], own[by]
        for j in order[c]:
            near = np.searchsorted(-own, -(-(-between[c, j] // 4)), "right")
            rows, own = rows[:near], own[:near]
            if not near:
                break
            d = square(x[rows], centroids[j])
            nearer = (d < least[rows]) | (d == least[rows]) & (j < best[rows])
            least[rows[nearer]], best[rows[nearer]] = d[nearer], j
    return best, least


def step(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Vectors with their nearest centroid; and a row for each cluster of each block (v null): its count, sums of components, and of the upper and lower 32 bits of the distances."""
    k, size = centroids.shape
    between = np.array([square(centroids, c) for c in centroids])
    order = np.argsort(between, axis=1, kind="stable")
    names = ["vec_id", "v", "cluster", "distance", "sums"]
    of_sums = pa.list_(pa.int64())

    def block(ids, v, x, before):
        best, least = assign(x, before, centroids, between, order)
        some, at, count = np.unique(best, return_inverse=True, return_counts=True)
        sums = np.zeros((len(some), size + 3), np.int64)
        np.add.at(sums, at, np.column_stack([x, least >> 32, least & 0xFFFFFFFF, np.ones(len(x), np.int64)]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, size + 3), pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([ids, v, pa.array(best, pa.int32()), pa.array(least), pa.nulls(len(x), of_sums)], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), v.type), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), flat.cast(of_sums)], names=names)

    def run(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            x = v.flatten().to_numpy().astype(np.int64).reshape(-1, size)
            before = batch.column(2).to_numpy().astype(np.int64)
            for lo in range(0, batch.num_rows, BLOCK):
                n = min(BLOCK, batch.num_rows - lo)
                yield from block(ids.slice(lo, n), v.slice(lo, n), x[lo : lo + n], before[lo : lo + n])

    return arrow_map(vectors.select("vec_id", "v", "cluster"), run, "vec_id long, v array<int>, cluster int, distance long, sums array<long>")


def totals(assigned: DataFrame, k: int, size: int) -> np.ndarray:
    """For each centroid (objects, so exact): sums of components, inertia, count."""
    each = assigned.where("sums is not null").select("cluster", F.posexplode("sums").alias("i", "s"))
    out = np.zeros((k, size + 3), object)
    for r in each.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r.cluster, r.i] = int(r.s)
    return np.column_stack([out[:, :size], (out[:, size] * (1 << 32) + out[:, size + 1]), out[:, size + 2]])


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each non-empty centroid at the floor of the mean of its vectors."""
    return np.array([[int(s) // int(n) for s in row] if n else list(c) for c, row, n in zip(centroids, sums[:, :-2], sums[:, -1], strict=True)], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, column: str = "embedding", size: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and v of every vector that is kept."""
    now = whole(vectors, column, size)
    centroids = first_centroids(now, k)
    if not len(centroids):  # no vector with an id: those without are not clustered by anything
        return now.where(F.lit(False)).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256", "v")
    now, spark, scope = now.withColumn("cluster", F.lit(0)), vectors.sparkSession, f"sort-means-{uuid.uuid4().hex}"
    for turn in range(rounds + 1):
        found = materialize(step(now, centroids), f"{scope}-{turn}")
        drop_scratch(spark, f"{scope}-{turn - 1}")
        sums, now = totals(found, *centroids.shape), found.where("sums is null")
        if turn < rounds:
            centroids = moved(centroids, sums)
    inertia = [min(int(x), (1 << 63) - 1) for x in (*sums[:, -2], sums[:, -2].sum())]
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, inertia[i], inertia[-1], names[i]) for i in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "v", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "v")
