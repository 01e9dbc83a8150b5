"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours; a grouped minimum joined back, so that a node with very many neighbours is only a skewed join side."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the least node it reaches.

    Rounds are cut by checkpoints where spark.checkpoint.dir is set, else by Spark's own lineage.
    """
    spark = links.sparkSession
    kept = spark.conf.get("spark.checkpoint.dir", None)

    held: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        if not kept:
            # One round's rows stay cached until the next round's are.
            held.append(df.persist())
            return held[-1]
        if not spark._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(kept)
        return df.checkpoint()

    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        edges = cut(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = mark(edges)
        while len(held) > 1:
            held.pop(0).unpersist()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
