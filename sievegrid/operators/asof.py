"""As-of lookups for many times at once: the state that each record had at each of its own times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(lookups: DataFrame, states: DataFrame, keys: list[str], at: str, order: list[str], values: list[str], range_s: int = 86_400) -> DataFrame:
    """lookups with the values of the last state of their keys at or before their time; NULL before the first.

    at: whole seconds, in both. order: what tells states of one time apart, the last counts. Times are
    parted into ranges, and a key's ranges lie in tasks of their own, so a hot key spreads; of each range
    only its last state is carried on, so what passes in order is one short row per key and range.
    """
    part, side, state = "_range", "_side", "_state"
    ranged = lambda df: df.withColumn(part, F.floor(F.col(at) / range_s))
    there = ranged(states).select(*keys, part, F.col(at), F.struct(F.col(at), *order, *values).alias(state))
    asked = ranged(lookups).withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in lookups.columns]))
    # The last state before each range that is asked about.
    ends = there.groupBy(*keys, part).agg(F.max(state).alias(state))
    marks = ends.unionByName(asked.select(*keys, part).distinct(), allowMissingColumns=True).groupBy(*keys, part).agg(F.max(state).alias(state))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_before", F.last(state, ignorenulls=True).over(earlier)).where("_before is not null").select(*keys, part, "_before")
    both = there.select(*keys, part, at, F.lit(0).alias(side), state, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    both = both.unionByName(asked.select(*keys, part, at, F.lit(1).alias(side), F.lit(None).cast(there.schema[state].dataType).alias(state), "_row"))
    inside = Window.partitionBy(*keys, part).orderBy(at, side, state).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("_last", F.last(state, ignorenulls=True).over(inside)).where(F.col(side) == 1).join(carried, [*keys, part], "left")
    return told.select("_row.*", *[F.coalesce("_last", "_before")[v].alias(v) for v in values])
