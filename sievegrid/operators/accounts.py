"""What belongs to accounts: exports, profiles, states with their histories, indexes, preferences.

Lists are kept short where they are made into arrays: only so many rows of an owner are ranked, which Spark
cuts in each task before the shuffle. An export is lines, not one value for an account, so no owner's rows
meet in one place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Part(NamedTuple):
    """A table of an account: rows, the owner's column, what orders them, and the columns that are given out."""

    rows: DataFrame
    owner: str
    order: list[Column]
    columns: list[str]


def export_lines(users: DataFrame, key: str, account: list[str], parts: dict[str, Part], at: dict[str, str]) -> DataFrame:
    """(key, part, at, line) of every account: one line of JSON for itself and one for each row of its parts; at orders a part's lines.

    Rows of owners who are no users are left out, and NULLs are kept in the lines.
    """
    line = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    out = users.select(key, F.lit("account").alias("part"), F.lit(None).cast("string").alias("at"), line(account).alias("line"))
    for name, part in parts.items():
        own = part.rows.select(F.col(part.owner).alias(key), F.lit(name).alias("part"), F.col(at[name]).cast("string").alias("at"), line(part.columns).alias("line"))
        out = out.unionByName(own.join(users.select(key), key, "left_semi"))
    return out


def newest(part: Part, most: int) -> DataFrame:
    """(owner, items): of each owner the first so many rows by the part's order, as an array of structs in that order."""
    place = F.row_number().over(Window.partitionBy(part.owner).orderBy(*part.order))
    few = part.rows.withColumn("_place", place).where(F.col("_place") <= most)
    items = F.array_sort(F.collect_list(F.struct("_place", *part.columns)))  # most rows
    plain = F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in part.columns]))
    return few.groupBy(part.owner).agg(plain.alias("items"))


def profiles(users: DataFrame, key: str, parts: dict[str, tuple[Part, int]]) -> DataFrame:
    """users with an array for each part: its owner's first rows, so many at most; empty where there are none."""
    out = users
    for name, (part, most) in parts.items():
        got = newest(part, most).select(F.col(part.owner).alias(key), F.col("items").alias(name))
        out = out.join(got, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def states(cards: DataFrame, key: list[str], followups: DataFrame, history: Part, most: int, new: str = "NEW") -> DataFrame:
    """cards with their follow-up's status (new if there is none) and the first so many rows of its history.

    followups: key, followup, status. history is owned by followup.
    """
    told = newest(history, most).withColumnsRenamed({history.owner: "followup", "items": "history"})
    joined = cards.join(followups.select(*key, "followup", "status"), key, "left").join(told, "followup", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit(new))).withColumn("history", F.coalesce("history", F.array()))


def status_index(followups: DataFrame, owner: str, order: list[Column], known: list[str], most: int) -> DataFrame:
    """Of each owner the first so many follow-ups, without those of unknown status, and truncated: whether there were more."""
    by = Window.partitionBy(owner)
    few = followups.withColumn("_place", F.row_number().over(by.orderBy(*order))).where(F.col("_place") <= most + 1)
    marked = few.withColumn("truncated", F.max("_place").over(by) > most)
    return marked.where((F.col("_place") <= most) & F.col("status").isin(known)).drop("_place")


def preference(users: DataFrame, key: str, said: DataFrame, order: list[str], value: str, allowed: list[int], default: int) -> DataFrame:
    """(key, value): the last allowed value that each user said, else the default; folded in each task."""
    last = said.where(F.col(value).isin(allowed)).groupBy(key).agg(F.max(F.struct(*order, value))[value].alias(value))
    return users.select(key).join(last, key, "left").select(key, F.coalesce(value, F.lit(default)).alias(value))


def left_empty(members: DataFrame, group: str, leaves: Column) -> DataFrame:
    """Groups all of whose members leave, with how many they were."""
    counted = members.groupBy(group).agg(F.count("*").alias("had"), F.count_if(~F.coalesce(leaves, F.lit(False))).alias("_stay"))
    return counted.where("_stay = 0").drop("_stay")
