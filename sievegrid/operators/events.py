"""Correction and termination events, folded as of a time and applied to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame, keys: list[str], order: list[str], as_of: Column, at: str, path: Column, value: Column, unresolved: Column, sticky: Column, terminal: Column) -> DataFrame:
    """Per key: overrides (map of path to value), suppressed, terminated, n_events, of events not after as_of.

    A path's last statement wins. It is open while that statement leaves it unresolved; a sticky
    marker stays open whatever follows. Open paths and terminations suppress the record.
    """
    known = events.where(F.col(at) <= as_of).withColumns({"_path": path, "_value": value, "_open": F.coalesce(unresolved, F.lit(False)), "_sticky": F.coalesce(sticky, F.lit(False)), "_end": F.coalesce(terminal, F.lit(False))})
    # One row for each key and path first, folded in each task: a key with many events is no hot task.
    stated = known.groupBy(*keys, "_path").agg(
        F.max(F.struct(*order, F.col("_open").alias("o"))).alias("last"),
        F.max(F.when(F.col("_value").isNotNull(), F.struct(*order, F.col("_value").alias("v")))).alias("set"),
        F.max("_sticky").alias("sticky"),
        F.max("_end").alias("end"),
        F.count("*").alias("n"),
    )
    open_ = (F.col("_path").isNotNull() & F.col("last.o")) | F.col("sticky")
    pair = F.when(F.col("_path").isNotNull() & F.col("set").isNotNull(), F.struct(F.col("_path").alias("key"), F.col("set.v").alias("value")))
    return stated.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("overrides"),
        (F.max(open_) | F.max("end")).alias("suppressed"),
        F.max("end").alias("terminated"),
        F.sum("n").alias("n_events"),
    )


def applied(records: DataFrame, state: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Records with their overrides; suppressed ones go."""
    joined = records.join(state, keys, "left").where(~F.coalesce(F.col("suppressed"), F.lit(False)))
    changes = {f: F.coalesce(F.try_element_at("overrides", F.lit(f)).cast(records.schema[f].dataType), F.col(f)) for f in fields}
    return joined.withColumns(changes).select(*records.columns)
