"""Ranks, pages, latest per group and budgeted selection, with ties broken by a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first n rows with their rank. Each task keeps n rows; only those meet."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn(rank_col, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], most: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Rank 1..n in each group; with most, Spark keeps that many of a group in each task before the shuffle."""
    out = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if most is None else out.where(F.col(rank_col) <= most)


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str], where: Column | None = None) -> DataFrame:
    """Of each group the values of its last row by this order; folded in each task, so a hot group is no hot task."""
    rows = df if where is None else df.where(where)
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_last"))
    return last.select(*keys, *[F.col("_last")[v].alias(v) for v in values])


def earliest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_first"))
    return first.select(*keys, *[F.col("_first")[v].alias(v) for v in values])


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page with has_more, told from one row of look-ahead."""
    some = df.orderBy(*order).offset(offset).limit(size + 1)
    numbered = some.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return numbered.withColumn("has_more", F.max("place").over(Window.partitionBy(F.lit(0))) > size).where(F.col("place") <= size)


def budgeted(df: DataFrame, source: str, is_carried: Column, order: list[Column], cap: int, key: list[str]) -> DataFrame:
    """selected or deferred, with a quarter of each source's cap (one at least) reserved for its backlog.

    Slots that one side leaves unused go to the other. key tells rows apart. Only the first cap rows
    of each side are ever ranked, which Spark keeps in each task before the shuffle; the rest are deferred.
    """
    side = df.withColumn("_carried", F.coalesce(is_carried, F.lit(False)))
    counts = side.groupBy(source).agg(F.count_if(~F.col("_carried")).alias("_c"), F.count_if("_carried").alias("_k"))
    c, k, whole = F.col("_c"), F.col("_k"), F.lit(cap)
    reserved = F.when(k > 0, F.least(k, F.greatest(F.lit(1), F.floor(whole / 4)))).otherwise(0)
    current = F.least(c, F.greatest(F.lit(0), whole - reserved))
    backlog = reserved + F.least(k - reserved, whole - current - reserved)
    current = current + F.least(c - current, whole - current - backlog)
    shares = counts.select(source, current.alias("_take_c"), backlog.alias("_take_k"))
    placed = side.withColumn("_place", F.row_number().over(Window.partitionBy(source, "_carried").orderBy(*order))).where(F.col("_place") <= cap)
    take = F.when(F.col("_carried"), F.col("_take_k")).otherwise(F.col("_take_c"))
    picked = placed.join(shares, source).where(F.col("_place") <= take).select(*key).withColumn("_picked", F.lit(True))
    return df.join(picked, key, "left").withColumn("selected", F.col("_picked").isNotNull()).drop("_picked")


def due_source(df: DataFrame, now: Column, completed: str, interval_s: str, tie: str) -> DataFrame:
    """The most overdue source: never completed first, then the longest over its interval."""
    overdue = now - F.col(completed) - F.col(interval_s)
    due = df.withColumn("overdue", overdue).where(F.col(completed).isNull() | (F.col("overdue") >= 0))
    return due.orderBy(F.col("overdue").desc_nulls_first(), F.col(tie).asc()).limit(1)


def followed(df: DataFrame, owner: str, key: str, order: list[str], note: str, active: Column) -> DataFrame:
    """Each owner's entries by their last row: its note, those that are active, the last updated first."""
    last = df.groupBy(owner, key).agg(F.max(F.struct(*order, F.col(note).alias("note"), F.coalesce(active, F.lit(False)).alias("active"))).alias("_l"))
    rows = last.where("_l.active").select(owner, key, *[F.col("_l")[c].alias(c) for c in order], F.col("_l.note").alias("note"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.col(order[0]).desc(), key))
    return rows.withColumn("place", place)
