"""Batch forms of the change ledger, buckets, limits and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_reason(known: Column, same: Column, verified: Column, verified_same: Column, age_s: Column, every_s: int) -> Column:
    """Why a row must be verified again, in this order, or NULL: 0 new, 1 changed, 2 not verified, 3 due."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(known), 0).when(no(same), 1).when(no(verified) | no(verified_same), 2).when(age_s.isNull() | (age_s >= every_s), 3).cast("int")


def observed_changes(df: DataFrame, key: list[str], order: list[str], mark: Column, at: Column, every_s: int) -> DataFrame:
    """For each observation of a key the reason against the one before, which counts as verified."""
    by = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumns({"_mark": mark, "_at": at})
    rows = rows.withColumns({"_had": F.lag("_mark").over(by), "_was": F.lag("_at").over(by)})
    reason = change_reason(F.col("_was").isNotNull(), F.col("_mark") == F.col("_had"), F.lit(True), F.lit(True), F.col("_at") - F.col("_was"), every_s)
    return rows.withColumn("reason", reason).drop("_mark", "_at", "_had", "_was")


def rate_limited(df: DataFrame, key: str, at: Column, order: list[str], window_s: int, most: int) -> DataFrame:
    """Each hit with its number in its epoch-aligned window; those beyond the limit are limited."""
    rows = df.withColumn("window_start", (F.floor(at / window_s) * window_s).cast("long"))
    hits = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(*order))
    return rows.withColumn("hits", hits).withColumn("limited", F.col("hits") > most)


def first_hit_windows(df: DataFrame, key: str, at: str, window_s: int, most: int) -> DataFrame:
    """Each hit with the window it falls in, where a window starts at the first hit after the last one ended.

    at: seconds. Hits of one second are counted before the shuffle, so a key costs its distinct seconds;
    those pass in order through an Arrow pass that keeps one key, its window's start and its count.
    """
    kind = dict(df.dtypes)[key]
    seconds = df.groupBy(F.col(key), F.col(at).cast("long").alias("at")).agg(F.count("*").alias("n"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = start = None
        before, any_yet = 0, False
        for batch in batches:
            starts, firsts = [], []
            for k, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_yet or k != who or t >= start + window_s:
                    who, start, before, any_yet = k, t, 0, True
                starts.append(start)
                firsts.append(before + 1)
                before += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(firsts, pa.int64())], names=[key, "at", "n", "window_start", "first"])

    told = seconds.repartition(key).sortWithinPartitions(key, "at").mapInArrow(walk, f"`{key}` {kind}, at long, n long, window_start long, first long")
    hits = told.select(key, "at", "window_start", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("hits"))
    return hits.withColumn("hits", F.col("hits").cast("int")).withColumn("limited", F.col("hits") > most)


def once_per_bucket(df: DataFrame, source: str, bucket: Column, order: list[str]) -> DataFrame:
    """The first row of each source and bucket."""
    rest = [c for c in df.columns if c != source]
    one = df.withColumn("bucket", bucket).groupBy(source, "bucket").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return one.select(source, "bucket", *[F.col("_r")[c].alias(c) for c in rest])


def carried_over(pending: DataFrame, scanned: DataFrame, key: str, now: Column, seen: str, hours: int = 48, unresolved: Column | None = None) -> DataFrame:
    """Pending rows that the last scan does not have, while they are recent enough and, if told, unresolved."""
    rows = pending if unresolved is None else pending.where(F.coalesce(unresolved, F.lit(False)))
    return rows.join(scanned.select(key).distinct(), key, "left_anti").where(now - F.col(seen) <= hours * 3600)


def unresolved(status: Column, fingerprint: Column, verified: Column) -> Column:
    """Not verified, or verified for another fingerprint."""
    return ~F.coalesce((status == VERIFIED) & (fingerprint == verified), F.lit(False))


def pruned(ledger: DataFrame, now: Column, seen: str, days: int = 45) -> DataFrame:
    """Rows not seen for so many days, or seen in the future, go."""
    return ledger.where((F.col(seen) <= now) & (now - F.col(seen) <= days * 86_400))


def next_interval(base_s: Column, quiet: Column, pending: Column) -> Column:
    """A quiet scan doubles the interval, unless a newer attempt is pending."""
    return F.when(quiet & ~F.coalesce(pending, F.lit(False)), base_s * 2).otherwise(base_s)


def released(staged: DataFrame, source: str, failed: Column) -> DataFrame:
    """Rows of sources in which nothing is left failed: one failure holds back all of its source."""
    held = staged.groupBy(source).agg(F.max(F.coalesce(failed, F.lit(False))).alias("_held"))
    return staged.join(held, source).where(~F.col("_held")).drop("_held")


def trailing_run(df: DataFrame, key: str, order: list[str], holds: Column) -> DataFrame:
    """Per key how many of its last rows in a row fulfil a condition, and its rows; folded, not windowed."""
    place = F.struct(*order)
    return df.groupBy(key).agg(F.max(F.when(~F.coalesce(holds, F.lit(False)), place)).alias("_break"), F.count("*").alias("n_rows")).join(
        df.select(key, place.alias("_place")), key
    ).groupBy(key).agg(F.max("n_rows").alias("n_rows"), F.count_if(F.col("_break").isNull() | (F.col("_place") > F.col("_break"))).alias("run"))


# States of a ledger row.
UNVERIFIED, VERIFIED, FAILED = "UNVERIFIED", "VERIFIED", "FAILED"


def observed(ledger: DataFrame, scan: DataFrame, key: str, now: Column) -> DataFrame:
    """The ledger after a scan (key, fingerprint): rows seen again keep their history, a new fingerprint is unverified anew, new keys come in.

    ledger: key, fingerprint, first_seen, last_seen, last_verified, verified_fingerprint, status, failures, last_error.
    """
    s = scan.select(F.col(key), F.col("fingerprint").alias("_now")).dropDuplicates([key])
    j = ledger.join(s, key, "full_outer")
    seen, fresh = F.col("_now").isNotNull(), F.col("first_seen").isNull()
    changed = seen & ~F.col("fingerprint").eqNullSafe(F.col("_now"))
    return j.select(
        key,
        F.coalesce("_now", "fingerprint").alias("fingerprint"),
        F.when(fresh, now).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        "last_verified",
        "verified_fingerprint",
        F.when(fresh | changed, UNVERIFIED).otherwise(F.col("status")).alias("status"),
        F.when(fresh | changed, 0).otherwise(F.col("failures")).cast("int").alias("failures"),
        F.when(~(fresh | changed), F.col("last_error")).alias("last_error"),
    )


def settled(ledger: DataFrame, outcomes: DataFrame, key: str, now: Column, cap: int = 500) -> DataFrame:
    """The ledger after verifications (key, error; NULL: success): success verifies the present fingerprint, failure counts up and keeps its error."""
    o = outcomes.select(key, F.col("error").alias("_error"), F.lit(True).alias("_done")).dropDuplicates([key])
    j = ledger.join(o, key, "left")
    won = F.col("_done").isNotNull() & F.col("_error").isNull()
    lost = F.col("_error").isNotNull()
    return j.withColumns({
        "last_verified": F.when(won, now).otherwise(F.col("last_verified")),
        "verified_fingerprint": F.when(won, F.col("fingerprint")).otherwise(F.col("verified_fingerprint")),
        "status": F.when(won, VERIFIED).when(lost, FAILED).otherwise(F.col("status")),
        "failures": F.when(won, 0).when(lost, F.coalesce("failures", F.lit(0)) + 1).otherwise(F.col("failures")).cast("int"),
        "last_error": F.when(lost, F.substring("_error", 1, cap)).when(~won, F.col("last_error")),
    }).drop("_error", "_done")


def after_full_cycle(staged: DataFrame, cycles: DataFrame, source: str, at: str, completed: str) -> DataFrame:
    """Staged rows of sources that no full cycle has completed since they were staged: a full cycle speaks for all of its source."""
    last = cycles.groupBy(source).agg(F.max(completed).alias("_done"))
    return staged.join(last, source, "left").where(F.col("_done").isNull() | (F.col(at) > F.col("_done"))).drop("_done")


def stage_faults(runs: DataFrame, cycle: str, order: list[str], stage: str, status: str, stages: list[str], attempts: int = 2) -> DataFrame:
    """Attempts at stages with the code of what is wrong: an unknown stage, one begun before all earlier ones succeeded, too many attempts, one after success."""
    by = Window.partitionBy(cycle).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.array_position(F.array(*map(F.lit, stages)), F.col(stage))
    done = F.coalesce(F.max(F.when(F.col(status) == "SUCCEEDED", F.col("_at"))).over(by), F.lit(0))
    tried = F.count_if(F.col(status) == "FAILED").over(Window.partitionBy(cycle, stage).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("_at", at)
    fault = F.when(F.col("_at") == 0, "STAGE_UNKNOWN").when(F.col("_at") > done + 1, "STAGE_OUT_OF_ORDER").when(F.col("_at") <= done, "STAGE_ALREADY_DONE").when(tried >= attempts, "ATTEMPTS_EXHAUSTED")
    return rows.withColumn("fault", fault).drop("_at")


def sliced(df: DataFrame, order: list[str], size: int = 5, slices: int = 6) -> DataFrame:
    """The first rows in order, dealt to slices of so many; rows beyond the last slice are left out, as a cycle has no more stages."""
    first = df.orderBy(*order).limit(size * slices)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    return first.withColumn("slice", F.floor(place / size).cast("int"))


def cache_state(status: Column, age_s: Column, fresh_s: int, retry_s: int, pending_s: int) -> Column:
    """USE a fresh result, WAIT on one that is being made or failed lately, else REFRESH."""
    return (
        F.when((status == "READY") & (age_s <= fresh_s), "USE")
        .when((status == "PENDING") & (age_s <= pending_s), "WAIT")
        .when((status == "FAILED") & (age_s <= retry_s), "WAIT")
        .otherwise("REFRESH")
    )


def next_tick(minute: Column, first: int = 690, last: int = 1140, step: int = 15) -> Column:
    """The first minute of the day's grid after a minute of the day, missed ones skipped; NULL after the last."""
    due = F.when(minute < first, F.lit(first)).otherwise(first + (F.floor((minute - first) / step) + 1) * step)
    return F.when(due <= last, due).cast("int")


def bootstrapped(discovered: DataFrame, entries: DataFrame, canonical: DataFrame, key: str, now: Column, updated_at: Column, recent_s: int, strict: Column) -> DataFrame:
    """discovered (key, fingerprint, title, published_at) with the disposition of what is verified of it already.

    entries: the ledger before (key, fingerprint, status, verified_fingerprint, last_verified, last_seen; times in seconds).
    canonical: verified records (key, title, published_at, observed), one for a key. updated_at: when the ledger was written
    last, NULL if never. strict: index and record are expected to say the same; where they need not, only a fingerprint that
    was seen before the verification bridges them. Disposition, the first that holds: NULL (nothing verified, or only in the
    future), STALE, METADATA_CHANGED, NEWER_VERIFIED, NEWER_STATE, METADATA_MISMATCH, BRIDGE_TOO_OLD, BRIDGED, SEEDED.
    """
    d = discovered.select(key, "fingerprint", "title", "published_at")
    e = entries.select(key, F.lit(True).alias("_had"), F.col("fingerprint").alias("_mark"), "status", "verified_fingerprint", "last_verified", "last_seen")
    c = canonical.select(key, F.col("title").alias("_title"), F.col("published_at").alias("_published"), "observed")
    yes = lambda x: F.coalesce(x, F.lit(False))
    had, at = yes(F.col("_had")), F.col("observed")
    same_mark = had & F.col("_mark").eqNullSafe(F.col("fingerprint"))
    verified = had & yes((F.col("status") == "VERIFIED") & (F.col("verified_fingerprint") == F.col("fingerprint"))) & F.col("last_verified").isNotNull()
    differ = lambda x, y: yes((F.trim(x) != "") & (F.trim(y) != "") & (F.trim(x) != F.trim(y)))
    match = strict & ~differ(F.col("title"), F.col("_title")) & ~differ(F.col("published_at"), F.col("_published"))
    disposition = (
        F.when(at.isNull() | (at > now), None)
        .when(now - at > recent_s, "STALE")
        .when(had & ~same_mark, "METADATA_CHANGED")
        .when(verified & (F.col("last_verified") >= at), "NEWER_VERIFIED")
        .when(had & ~verified & yes(updated_at >= at), "NEWER_STATE")
        .when(~match & ~same_mark, "METADATA_MISMATCH")
        .when(~match & ~yes(at >= F.col("last_seen")), "BRIDGE_TOO_OLD")
        .when(~match, "BRIDGED")
        .otherwise("SEEDED")
    )
    return d.join(e, key, "left").join(c, key, "left").select(key, disposition.alias("disposition"), "observed")
