"""Merges, differences and versions of keyed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.operators.components import components

#: Rows of a table of linked numbers (two longs each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _one(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _one(df, keys, order, F.max)


def _one(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """Grouped extremes, not a window: each task folds a hot key to one row before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    one = df.groupBy(*keys).agg(pick(F.struct(*[c for c in order if c not in keys], *rest)).alias("_row"))
    return one.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def set_delta(old: DataFrame, new: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Each key of either side as new, removed, changed or reused."""
    a = old.select(*keys, F.col(mark).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(mark).alias("_new"), F.lit(True).alias("_in_new"))
    state = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "reused").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Sorted names of the fields that differ, NULL-safe."""
    return F.array_compact(F.array(*[F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in sorted(after)]))


def versions(df: DataFrame, key: str, order: list[str], fact: Column, strict: bool = False) -> DataFrame:
    """The rows of df at which the fact changed, numbered per key in order.

    strict: a fact that the key had before makes no version row, though it counts.
    """
    by = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_fact", fact).withColumn("_before", F.lag("_fact").over(by)).withColumn("_at", F.row_number().over(by))
    changes = marked.where((F.col("_at") == 1) | ~F.col("_fact").eqNullSafe(F.col("_before")))
    out = changes.withColumn("version", F.row_number().over(by))
    if strict:
        out = out.withColumn("_seen", F.row_number().over(Window.partitionBy(key, "_fact").orderBy(*order))).where("_seen = 1").drop("_seen")
    return out.drop("_fact", "_before", "_at")


def upsert_versions(current: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """What one observation per key does to the current rows: create, stale, touch or version.

    current: key, fact_hash, version, last_seen. observed: key, fact_hash, seen. Equal times are not stale.
    """
    c = current.select(key, F.col("fact_hash").alias("_had"), F.col("version").alias("_version"), "last_seen")
    action = F.when(F.col("_version").isNull(), "create").when(F.col("seen") < F.col("last_seen"), "stale").when(F.col("fact_hash") == F.col("_had"), "touch").otherwise("version")
    joined = observed.join(c, key, "left").withColumn("action", action)
    number = F.when(F.col("action") == "create", 1).when(F.col("action") == "version", F.col("_version") + 1).otherwise(F.col("_version"))
    return joined.select(key, "fact_hash", "seen", "action", number.cast("int").alias("version"))


def merge_by_two_keys(df: DataFrame, group: str, order: str, id_col: str, number_col: str) -> DataFrame:
    """Replay rows in order: a row takes the first slot that has its id, or its number in its group, and clears other matches.

    Returns the rows left, with slot: the order of the row that opened their slot. Ids meet across
    groups (markets), numbers only inside one. NULL ids and numbers match nothing; orders are distinct.

    Rows that no chain of ids and numbers joins cannot meet, so each connected component is replayed
    by itself. Components are of numbers; ids link the numbers they occur with, and an id of one number
    links nothing, so few edges are left. All components of a task come in one stream sorted by
    component and order; what is held is a batch and the live slots of the component at hand.
    """
    node, key, root = "_node", "_key", "_root"
    # Two numbers of one hash would only put more rows into one replay.
    named = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit("id"), F.col(id_col)))
    numbered = F.when(F.col(number_col).isNotNull(), F.xxhash64(F.lit("number"), F.col(group), F.col(number_col)))
    keyed = df.withColumn(key, named).withColumn(node, F.coalesce(numbered, F.col(key), F.xxhash64(F.lit("row"), F.col(order))))
    # An id's numbers come in order, so its least one is at hand at each of them: one shuffle of two longs a row.
    least = F.min(node).over(Window.partitionBy(key).orderBy(node))
    links = keyed.where(F.col(key).isNotNull()).select(key, node).withColumn("a", least).where(F.col("a") != F.col(node)).select("a", F.col(node).alias("b")).distinct()
    roots = components(links).select(F.col("node").alias(node), F.col("root").alias(root))
    # Whole rows move once, to their root, while the linked numbers are few enough to come to the rows.
    few = roots.count() <= BROADCAST_ROWS
    placed = keyed.drop(key).join(F.broadcast(roots) if few else roots, node, "left").withColumn(root, F.coalesce(root, node))
    sorted_ = placed.select(*df.columns, root).repartition(root).sortWithinPartitions(root, order)
    columns = [group, order, id_col, number_col, root]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows that are some slot's, of the component at hand
        at = None
        slots: dict[int, tuple[int, object, object]] = {}  # by opening: place in held, id, number
        by_id: dict = {}
        by_number: dict = {}
        opened: dict[int, object] = {}  # order of the row that opened the slot
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            done: list[tuple[int, object]] = []
            for i, (of, seq, name, number, component) in enumerate(zip(*(rows.column(c).to_pylist() for c in columns), strict=True), len(held) - len(rows)):
                if component != at:
                    done += [(place, opened[s]) for s, (place, _, _) in slots.items()]
                    at, slots, by_id, by_number, opened = component, {}, {}, {}, {}
                whole = None if number is None else (of, number)
                hits = {s for s in (by_id.get(name) if name is not None else None, by_number.get(whole) if whole else None) if s is not None}
                for s in hits:
                    _, n, w = slots.pop(s)
                    by_id.pop(n, None) if by_id.get(n) == s else None
                    by_number.pop(w, None) if by_number.get(w) == s else None
                slot = min(hits) if hits else len(opened)
                if not hits:
                    opened[slot] = seq
                slots[slot] = i, name, whole
                if name is not None:
                    by_id[name] = slot
                if whole:
                    by_number[whole] = slot
            if done:
                yield from _with_slots(held, done, root, rows.schema.field(order).type)
            # What is left of the component at hand goes on to the next batch.
            live = list(slots)
            held = held.take(pa.array([slots[s][0] for s in live], pa.int64()))
            for i, s in enumerate(live):
                slots[s] = (i, *slots[s][1:])
        if held is not None and slots:
            yield from _with_slots(held, [(place, opened[s]) for s, (place, _, _) in slots.items()], root, held.schema.field(order).type)

    return sorted_.mapInArrow(replay, T.StructType([*df.schema.fields, T.StructField("slot", df.schema[order].dataType)]))


def _with_slots(held: pa.Table, done: list[tuple[int, object]], root: str, kind: pa.DataType) -> list[pa.RecordBatch]:
    kept = held.drop_columns([root]).take(pa.array([place for place, _ in done], pa.int64()))
    return kept.append_column("slot", pa.array([s for _, s in done], kind)).combine_chunks().to_batches()


def idempotent_states(df: DataFrame, key: str, mutation: str, order: list[str], status: str, remind: str, terminal: list[str]) -> DataFrame:
    """Per key the last status and the reminder it leaves: repeated mutations count once, a terminal status clears it."""
    once = first_wins(df, [key, mutation], order)
    by = Window.partitionBy(key).orderBy(*order)
    ended = F.sum(F.col(status).isin(terminal).cast("int")).over(by)
    held = F.last(remind, ignorenulls=True).over(Window.partitionBy(key, "_era").orderBy(*order))
    marked = once.withColumn("_era", ended).withColumn("reminder", F.when(~F.col(status).isin(terminal), held))
    from sievegrid.operators.ranking import latest

    return latest(marked, [key], order, [status, "reminder"])


def snapshot_conflicts(stored: DataFrame, arriving: DataFrame, key: str = "as_of", mark: str = "hash") -> DataFrame:
    """Arriving snapshots as insert, same (nothing to do) or conflict."""
    s = stored.select(key, F.col(mark).alias("_had"))
    state = F.when(F.col("_had").isNull(), "insert").when(F.col("_had") == F.col(mark), "same").otherwise("conflict")
    return arriving.join(s, key, "left").withColumn("state", state).drop("_had")


def capped_merge(preferred: DataFrame, other: DataFrame, keys: list[str], order: list[str], group: str, most: int) -> DataFrame:
    """Rows of both, those of preferred first; the first of each key stays, so many per group."""
    both = preferred.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    once = first_wins(both, [group, *keys], ["_side", *order])
    placed = once.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_side", *order)))
    return placed.where(F.col("_n") <= most).drop("_n", "_side")


def acknowledged(followups: DataFrame, acks: DataFrame, key: str, remind: str) -> DataFrame:
    """Follow-ups whose reminder is cleared where an acknowledgement names exactly that reminder."""
    seen = acks.select(key, F.col(remind).alias("_seen")).distinct()
    hit = seen.withColumn("_hit", F.lit(True))
    joined = followups.join(hit, (followups[key] == hit[key]) & (followups[remind] == hit["_seen"]), "left").drop(hit[key], hit["_seen"])
    return joined.withColumn(remind, F.when(F.col("_hit").isNull(), F.col(remind))).drop("_hit")


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def payload_if_changed(rows: DataFrame, known: Column, mark: str, payload: str) -> DataFrame:
    """rows with a NULL payload where its hash is the known one."""
    return rows.withColumn(payload, F.when(~F.col(mark).eqNullSafe(known), F.col(payload)))


def observation(facts_json: Column, verified: Column, key: Column, urls: Column, region: Column, lifecycle: Column) -> Column:
    """The observation that a card stands for, or NULL: verified, with an id and an https address.

    struct(opportunity_id, region_code, source_id, source_url, lifecycle_state, fact_hash); the first address in order is the source.
    """
    from sievegrid.functions import text

    https = F.array_sort(F.array_distinct(F.filter(urls, lambda u: u.rlike("(?i)^https://"))))
    name, url = text.capped(key, 200), F.get(https, F.lit(0))
    mark = F.sha2(F.concat(F.lit('{"evidence_source_urls":'), F.to_json(https), F.lit(',"facts":'), facts_json, F.lit(',"opportunity_id":'), text.json_string(name), F.lit("}")), 256)
    made = F.struct(name.alias("opportunity_id"), text.region_code(region).alias("region_code"), text.host(url).alias("source_id"), url.alias("source_url"), text.capped(lifecycle, 160).alias("lifecycle_state"), mark.alias("fact_hash"))
    return F.when((verified == "VERIFIED") & name.isNotNull() & (F.size(https) > 0), made)


def snapshot_checks(local: DataFrame, remote: DataFrame, key: str, rank: str, cards: int = 5) -> DataFrame:
    """One row: whether two snapshots (key, rank from 1) hold the same keys in the same order, in the pool and among its cards, with counts and the first rank that differs.

    Ranks meet by a join, so no list of keys is gathered.
    """
    a, b = local.select(rank, F.col(key).alias("_a")), remote.select(rank, F.col(key).alias("_b"))
    differ = ~F.col("_a").eqNullSafe(F.col("_b"))
    met = a.join(b, rank, "full")
    return met.agg(
        F.count("_a").alias("local_count"), F.count("_b").alias("remote_count"), (F.count_if(differ) == 0).alias("pool_ids"), (F.count_if(differ & (F.col(rank) <= cards)) == 0).alias("card_ids"), F.min(F.when(differ, F.col(rank))).alias("first_difference")
    ).withColumn("pool_count", F.col("local_count") == F.col("remote_count"))
