"""Connected components of an edge table, by alternating large-star and small-star rounds.

Before the rounds each task replaces the edges it reads by stars around their least nodes, which
keeps all connections, never adds edges, and leaves few rounds to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the least of u and its neighbours.

    A grouped minimum joined back, not a window: partial minima leave one row per task and node,
    and a node with very many neighbours is a skewed join side, which Spark splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _stars(edges: int):
    """Edges (u, v) to a star for each component that they have among themselves, for so many edges at a time."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        seen = 0

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def star() -> pa.RecordBatch:
            nodes = [x for x in parent if find(x) != x]
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                parent[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen > edges:
                yield star()
                parent, seen = {}, 0
        if parent:
            yield star()

    return contract


#: Edges that a task contracts at a time.
CONTRACTED = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, contract: bool = True) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the least node it reaches. contract: tasks first make stars of their edges, in Python.

    Each round writes its edges to the shared scratch folder, so lost executors cost one round.
    Links between a node and itself and repeated links do no harm; no links give no rows.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "edges")
    if contract:
        # The reader packs small files together, so few links meet in one task and need one round.
        edges = materialise(edges.mapInArrow(_stars(CONTRACTED), "u long, v long"), "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    # Stable edges are stars: each node points at its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
