"""Streams of observations: once per bucket, fixed-window limits, change reasons and versions.

Each returns what its batch form in operators.ledger or operators.merge returns for the same rows in
event order. Input needs a timestamp column; state lives in Spark's state store and is bounded by
the watermark or by a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_per_bucket(stream: DataFrame, source: str, at: str, minutes: int, late: str = "1 day") -> DataFrame:
    """The first row that arrives for each source and epoch-aligned bucket."""
    bucket = F.window(at, f"{minutes} minutes")["start"].alias("bucket")
    return stream.withWatermark(at, late).select("*", bucket).dropDuplicatesWithinWatermark([source, "bucket"])


def window_hits(stream: DataFrame, key: str, at: str, window: str, most: int, late: str = "1 day") -> DataFrame:
    """Hits per key and fixed window, and how many of them are over the limit."""
    hits = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("hits"))
    return hits.select(key, F.col("w.start").alias("window_start"), "hits", F.greatest(F.lit(0), F.col("hits") - most).alias("over"))


def change_reasons(stream: DataFrame, key: str, at: str, mark: str, every_s: int, ttl_days: int = 45, late: str = "1 day") -> DataFrame:
    """Per observation: 0 new, 1 changed, 3 due again, NULL unchanged; a key unseen for ttl_days counts as new.

    at: seconds, long. Rows of a micro-batch are taken in order of (at, mark). The state is one
    short row per key, dropped once the watermark (of at, less `late`) is ttl_days past its last row.
    """
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {at} long, {mark} string, reason int"

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([at, mark], kind="stable")
        had, was = state.get if state.exists else (None, None)
        reasons = []
        for now, value in zip(rows[at].tolist(), rows[mark].tolist(), strict=True):
            reasons.append(0 if was is None or now - was > ttl_days * 86_400 else 1 if value != had else 3 if now - was >= every_s else None)
            had, was = value, now
        state.update((had, was))
        state.setTimeoutTimestamp(max((was + ttl_days * 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], at: rows[at].to_numpy(), mark: rows[mark].to_numpy(), "reason": pd.array(reasons, "Int32")})

    timed = stream.select(key, at, mark, F.timestamp_seconds(at).alias("_ts")).withWatermark("_ts", late)
    return timed.groupBy(key).applyInPandasWithState(step, out, "had string, was long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_last(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str):
    """A writer that folds each micro-batch to its last row per key and keeps that as a folder of its own.

    A batch costs its own rows only, and one that runs again after a failure overwrites its own folder.
    last_rows reads the state; compacted folds old folders together.
    """
    from sievegrid.operators.merge import last_wins

    def fold(batch: DataFrame, n: int) -> None:
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def last_rows(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key over all batches of keep_last."""
    from sievegrid.operators.merge import last_wins

    return last_wins(spark.read.parquet(path).drop("batch"), keys, order)


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], order: list[str]) -> DataFrame:
    """Write the present state as the one batch of a new path, to be read and written on from there."""
    last_rows(spark, path, keys, order).write.parquet(f"{into}/batch=-1")
    return spark.read.parquet(into).drop("batch")
