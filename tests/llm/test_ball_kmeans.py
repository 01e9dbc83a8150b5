"""Ball k-means against comparing all with all, odd rows, and the balls' pruning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import ball_kmeans as B


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    return [[x + rng.gauss(0, 0.3) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread, rounds", [(0.2, 3), (3.0, 5), (40_000.0, 2)])
def test_same_as_all_with_all(spark, spread, rounds):
    rng = random.Random(spread)
    rows = list(enumerate(clustered(rng, 300, 8, spread)))
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one vector very often
    rows += [(2000 + i, [float(rng.randrange(2)) for _ in range(8)]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("cluster", F.lit("x"))
    want = B.plain_clusters({i: [int(np.floor(64 * x)) for x in v] for i, v in rows}, 7, rounds)
    got = B.cluster_vectors(df, k=7, rounds=rounds, dims=8).collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want and len(got) == len(rows)
    assert {r.inertia for r in got} == {sum(d for _, d in want.values())}
    for r in got[:20]:
        assert r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)
        assert r.distance == sum((a - b) ** 2 for a, b in zip(r.components, r.centroid, strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None], [1.0, nan], [inf, 1.0], [-inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(None, [9.0, 9.0]), (20, [1e30, 0.0]), (21, [0.5, -0.01]), (21, [0.5, -0.01]), (21, [0.0, 3.0])]
    got = B.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, dims=2, rounds=2).collect()
    assert sorted(str(r.vec_id) for r in got) == ["20", "21", "21", "21", "None"]
    assert [(r.cluster, r.distance) for r in got if r.vec_id == 20] == [(None, None)]
    assert all(r.cluster is not None for r in got if r.vec_id != 20)
    empty = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert B.cluster_vectors(empty, dims=2).count() == 0


def test_components_are_floors(spark):
    got = B.scaled_vectors(spark.createDataFrame([(1, [-0.01, 0.99999, 0.015625])], "vec_id long, embedding array<float>"), dims=3).first()
    assert got.v == [-1, 63, 1]


def test_neighbours_and_core():
    balls = [B.Ball((0, 0), 5), B.Ball((8, 0), 3), B.Ball((100, 0), 5), B.Ball((10, 0), 5)]
    assert B.neighbours(balls) == [[(64, 1), (100, 3)], [(4, 3)], [], [(4, 1), (100, 0)]]
    rng = np.random.default_rng(1)
    points = rng.integers(-40, 40, (500, 2))
    centroids = np.array([[0, 0], [10, 0], [0, 10], [20, 20], [0, 0]])
    before, _ = B.nearest_of_all(points, centroids + rng.integers(-6, 6, centroids.shape))
    far = [max([int(((points[before == i] - c) ** 2).sum(axis=1).max())], default=0) if (before == i).any() else 0 for i, c in enumerate(centroids)]
    balls = [B.Ball(tuple(map(int, c)), int(f**0.5) + 1) for c, f in zip(centroids, far, strict=True)]
    for got, want in zip(B.nearest_by_balls(points, before, centroids, B.neighbours(balls)), B.nearest_of_all(points, centroids), strict=True):
        assert (got == want).all()
