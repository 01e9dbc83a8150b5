"""Centroid clustering by ball k-means over integer vectors.

A cluster is a ball: its centroid and the largest distance of a member. After a round the driver has
sums, counts and radii of the k balls only. A centroid can take a member of ball i only if it lies
within twice the ball's radius of centroid i; those are the ball's neighbours, in order of distance.
A member nearer to its centroid than half the way to the first neighbour is in the stable core and
stays uncompared; one in the n-th annulus is compared with the first n neighbours, exactly.

Vectors and their clusters are a written table, one for each round, so a lost executor costs its
tasks of that round; nothing is dealt by a key, so the size of a cluster does not matter.

Defined results: vectors that are null, of another length, or with a null or non-finite component
are not kept and give no rows. Rows that repeat count each. A null id never starts a centroid while
others are left; of equal ids the smaller vector starts first; fewer rows than k start fewer
clusters; an empty table gives no rows. A vector with a scaled component beyond 2^27 has no squared
distance in a long: it is returned with null cluster and distance and moves no centroid. Only the id
and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.llm.common import materialise, named

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Scaled components up to this size keep every squared distance of 64 components within 63 bits.
LARGEST = 1 << 27
#: Up to this size, dot products of 64 components are exact in doubles.
_EXACT = 1 << 22


@dataclass(frozen=True)
class Ball:
    """A cluster: centroid, and a bound of its members' distance from it (whole, not squared)."""

    centroid: tuple[int, ...]
    radius: int


def squared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def neighbours(balls: list[Ball]) -> list[list[tuple[int, int]]]:
    """For each ball the others that may take a member of it: (squared distance, number), nearest first."""
    out = []
    for i, ball in enumerate(balls):
        apart = sorted((squared(ball.centroid, other.centroid), j) for j, other in enumerate(balls) if j != i)
        out.append([(d, j) for d, j in apart if d <= 4 * ball.radius**2])
    return out


def _distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest_of_all(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equals the smaller number) and its squared distance."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if largest <= _EXACT:
        dots = (vectors.astype(float) @ centroids.T.astype(float)).astype(np.int64)
        table = np.einsum("ij,ij->i", vectors, vectors)[:, None] - 2 * dots + np.einsum("ij,ij->i", centroids, centroids)
    else:
        table = np.stack([_distances(vectors, c) for c in centroids], axis=1)
    best = table.argmin(axis=1)
    return best, table[np.arange(len(best)), best]


def nearest_by_balls(vectors: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The same for vectors that have a cluster, by core and annuli."""
    best, least = cluster.copy(), np.zeros(len(cluster), np.int64)
    for i in np.unique(cluster):
        at = np.flatnonzero(cluster == i)
        own = _distances(vectors[at], centroids[i])
        number, found = np.full(len(at), i), own.copy()
        for apart, j in near[i]:
            outer = np.flatnonzero(4 * own.astype(object) >= apart) if apart >= 1 << 62 else np.flatnonzero(own >= -(-apart // 4))
            if not len(outer):
                break  # neighbours come nearest first: all members lie within this annulus
            other = _distances(vectors[at[outer]], centroids[j])
            taken = (other < found[outer]) | ((other == found[outer]) & (j < number[outer]))
            number[outer[taken]], found[outer[taken]] = j, other[taken]
        best[at], least[at] = number, found
    return best, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assign(rows: DataFrame, balls: list[Ball], width: int, first: bool) -> DataFrame:
    """rows with cluster and distance under these balls."""
    centroids, near = np.array([b.centroid for b in balls], np.int64), neighbours(balls)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("v"), width)
                if first:
                    cluster, distance = nearest_of_all(vectors, centroids)
                else:
                    cluster, distance = nearest_by_balls(vectors, batch.column("cluster").to_numpy().astype(np.int64), centroids, near)
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    schema = T.StructType([rows.schema["id"], rows.schema["v"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return rows.mapInArrow(assigned, schema)


def _moved(rows: DataFrame, balls: list[Ball], width: int) -> list[Ball]:
    """The balls after a round: floor of the mean, and the old radius with the centroid's way added."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, far = np.zeros((len(balls), width), object), [0] * len(balls), [0] * len(balls)
        for batch in batches:
            vectors, cluster = _matrix(batch.column("v"), width), batch.column("cluster").to_numpy()
            distance = batch.column("distance").to_numpy()
            for i in np.unique(cluster):
                own = cluster == i
                sums[i] += vectors[own].sum(axis=0)
                counts[i] += int(own.sum())
                far[i] = max(far[i], int(distance[own].max()))
        some = [i for i, n in enumerate(counts) if n]
        parts = [pa.array(some, pa.int32()), pa.array([[str(x) for x in sums[i]] for i in some], pa.list_(pa.string())), pa.array([counts[i] for i in some], pa.int64()), pa.array([far[i] for i in some], pa.int64())]
        yield pa.record_batch(parts, ["cluster", "sums", "n", "far"])

    partial = rows.select("v", "cluster", "distance").mapInArrow(folded, "cluster int, sums array<string>, n bigint, far bigint")
    columns = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    found = {r["cluster"]: r for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *columns).collect()}  # k rows
    out = []
    for i, ball in enumerate(balls):
        if i not in found:
            out.append(Ball(ball.centroid, 0))
            continue
        r = found[i]
        centroid = tuple(int(r[f"s{d}"]) // int(r["n"]) for d in range(width))
        out.append(Ball(centroid, math.isqrt(r["far"]) + 1 + math.isqrt(squared(centroid, ball.centroid)) + 1))
    return out


def scaled_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows with exactly dims finite components: floor(scale * x), in doubles; null where one is too large."""
    x, wide = named(vec_col), F.transform(named(vec_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    small = F.forall(x, lambda c: F.abs(F.floor(c.cast("double") * F.lit(float(scale))).cast("double")) <= LARGEST)
    return df.where(F.coalesce(whole, F.lit(False))).select(named(id_col).alias("id"), F.when(small, wide.cast("array<int>")).alias("v"))


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per kept vector: id, vector, cluster, squared distance, inertias, final centroid.

    The first centroids are the k vectors whose ids, after the seed and a colon, have the smallest
    SHA-256. Per-cluster columns come from a table of k rows.
    """
    spark = df.sparkSession
    all_rows = materialise(scaled_vectors(df, id_col, vec_col, dims, scale), "vectors")
    rows, beyond = all_rows.where("v is not null"), all_rows.where("v is null")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.select("v", draw.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    balls = [Ball(tuple(r.v), 0) for r in starts]
    out = "id, v, cast(null as int) as cluster, cast(null as bigint) as distance"
    if not balls:
        done = all_rows.selectExpr(*out.split(", "))
    else:
        state = materialise(_assign(rows, balls, dims, True), "clusters")
        for _ in range(rounds):
            balls = _moved(state, balls, dims)
            state = materialise(_assign(state, balls, dims, False), "clusters")
        done = state.unionByName(beyond.selectExpr(*out.split(", ")))
    own = done.where("cluster is not null").groupBy("cluster").agg(F.sum("distance").cast("bigint").alias("cluster_inertia")).collect()  # k rows
    table = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in own), list(balls[r.cluster].centroid)) for r in own]
    tops = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<int>")
    shown = done.join(F.broadcast(tops), "cluster", "left")
    return shown.select(F.col("id").alias(id_col), F.col("v").alias("components"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def plain_clusters(vectors: dict[int, list[int]], k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> dict[int, tuple[int, int]]:
    """The same by comparing all with all, for tests: id to cluster and squared distance."""
    order = sorted(vectors, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [tuple(vectors[i]) for i in order[:k]]
    told: dict[int, tuple[int, int]] = {}
    for r in range(rounds + 1):
        told = {i: min((squared(tuple(v), c), j) for j, c in enumerate(centroids)) for i, v in vectors.items()}
        if r < rounds:
            for j in range(len(centroids)):
                own = [vectors[i] for i, (_, x) in told.items() if x == j]
                if own:
                    centroids[j] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    return {i: (j, d) for i, (d, j) in told.items()}
