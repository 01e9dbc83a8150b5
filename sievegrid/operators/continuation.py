"""Continuation of bounded scans: segments that follow each other, unseen anchors, merged findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_faults(segments: DataFrame, root: str, index: str, anchors: str, mark: str, computed: Column, exhausted: str, resume: str) -> DataFrame:
    """Segments with the code of their first fault, or NULL.

    Indexes of a root count up from 0, fingerprints equal the recomputed ones, no anchor comes in
    two segments of a root, and only an exhausted segment has no page to resume from.
    """
    by = Window.partitionBy(root).orderBy(index)
    places = segments.select(root, index, F.explode(F.array_distinct(anchors)).alias("_anchor"))
    first = places.groupBy(root, "_anchor").agg(F.min(index).alias("_first"))
    shared = places.join(first, [root, "_anchor"]).where(F.col(index) > F.col("_first")).select(root, index).distinct().withColumn("_shared", F.lit(True))
    checked = segments.withColumn("_due", F.row_number().over(by) - 1).join(shared, [root, index], "left")
    fault = (
        F.when(F.col(index) != F.col("_due"), "INDEX")
        .when(~computed.eqNullSafe(F.col(mark)), "FINGERPRINT")
        .when(F.col("_shared"), "ANCHOR_SEEN")
        .when(F.col(exhausted) == F.col(resume).isNotNull(), "RESUME")
    )
    return checked.withColumn("fault", fault).drop("_due", "_shared")


def unseen(anchors: DataFrame, seen: DataFrame, source: str, url: str, page: str, place: str, room: int = 80, pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """The first unseen anchors of each source in page order, and the page to resume from where some are left."""
    fresh = anchors.join(seen.select(source, url).distinct(), [source, url], "left_anti")
    by = Window.partitionBy(source)
    numbered = fresh.withColumn("_n", F.row_number().over(by.orderBy(page, place))).withColumn("_page", F.dense_rank().over(by.orderBy(page)))
    fits = (F.col("_n") <= room) & (F.col("_page") <= pages)
    left = numbered.where(~fits).groupBy(source).agg(F.min(page).alias("resume_page"))
    return numbered.where(fits).drop("_n", "_page"), left


def merged_findings(ledger: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows (first_seen, last_seen, times_seen, active) with a segment's findings (keys, seen).

    Unlike a whole scan, a segment says nothing on rows that it does not have: they stay active.
    """
    new = found.groupBy(*keys).agg(F.min("seen").alias("_from"), F.max("seen").alias("_to"))
    joined = ledger.join(new, keys, "full_outer")
    return joined.select(
        *keys,
        F.least("first_seen", "_from").alias("first_seen"),
        F.greatest("last_seen", "_to").alias("last_seen"),
        (F.coalesce("times_seen", F.lit(0)) + F.when(F.col("_to").isNotNull(), 1).otherwise(0)).alias("times_seen"),
        F.coalesce(F.when(F.col("_to").isNotNull(), F.lit(True)), F.col("active")).alias("active"),
    )


def publish_gate(searches_ok: Column, selected: Column, verified: Column) -> Column:
    """NULL lets a batch through: no search succeeded, or rows were selected and none verified, stops it."""
    return F.when(searches_ok == 0, "NO_SEARCH_SUCCEEDED").when((selected > 0) & (verified == 0), "NOTHING_VERIFIED")


def prewarm_ids(cards: DataFrame, pool: DataFrame, key: str, order: str, score: str, eligible: Column, most: int) -> DataFrame:
    """Cards in order, then the pool by score: the first eligible distinct ids."""
    a = cards.where(eligible).select(key, F.lit(0).alias("_side"), F.col(order).cast("double").alias("_o"))
    b = pool.where(eligible).select(key, F.lit(1).alias("_side"), (-F.col(score)).cast("double").alias("_o"))
    first = a.unionByName(b).groupBy(key).agg(F.min(F.struct("_side", "_o", key)).alias("_f"))
    return first.orderBy("_f").limit(most).select(key)
