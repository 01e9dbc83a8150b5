"""Instants, local days, deadlines and windows. The clock and the zone are always arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970; a timestamp without zone counts as UTC, whatever the session's zone."""
    wall = ts.cast("timestamp_ntz")
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def instant(x: Column) -> Column:
    """A timestamp from ISO text that names its offset; anything else is NULL."""
    return F.when(x.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(x))


def is_date(x: Column) -> Column:
    return x.rlike(r"^\d{4}-\d{2}-\d{2}$") & x.try_cast("date").isNotNull()


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def end_of_day(day: Column, zone: str = ZONE) -> Column:
    """The last millisecond of a local day, as an instant."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone) - F.expr("INTERVAL 0.001 SECONDS")


def relative_deadline(published: Column, flags: Column, flag: str, days: int = 7, zone: str = ZONE) -> Column:
    """End of the local day some days after publication, for rows with the flag."""
    return F.when(F.array_contains(flags, flag), end_of_day(F.date_add(local_date(published, zone), days), zone))


def next_deadline(as_of: Column, *deadlines: Column) -> Column:
    """The first in this order that is still open; a deadline equal to as_of is closed."""
    return F.coalesce(*[F.when(d > as_of, d) for d in deadlines])


# Hours at most, and the name of the bucket.
URGENCY = [(24, "H24"), (72, "H72"), (168, "D7"), (336, "D14"), (720, "D30")]


def urgency(hours: Column) -> Column:
    """The bucket of the hours left; hours gone by count as none left."""
    out = F.lit("GT30D")
    for most, name in reversed(URGENCY):
        out = F.when(hours <= most, name).otherwise(out)
    return F.when(hours.isNull(), "NO_DEADLINE").otherwise(out)


def month_window(x: Column) -> Column:
    """struct(first, last), numbers of months (12 a year), from '2026年5月' or '2026年5月至7月'; NULL of anything else."""
    pattern = r"^\s*(20\d{2})年\s*(\d{1,2})\s*月?(?:\s*[-—~～至到]\s*(\d{1,2})月|(?<=月))\s*$"
    year, first, last = (F.regexp_extract(x, pattern, i).try_cast("int") for i in (1, 2, 3))
    last = F.coalesce(last, first)
    fits = x.rlike(pattern) & first.between(1, 12) & (last >= first) & (last <= 12)
    return F.when(fits, F.struct((year * 12 + first).alias("first"), (year * 12 + last).alias("last")))


def month_phase(x: Column, as_of: Column, zone: str = ZONE) -> Column:
    """BEFORE, ACTIVE or AFTER the window that the text states, by the local month; UNKNOWN if it states none."""
    day = local_date(as_of, zone)
    now, window = F.year(day) * 12 + F.month(day), month_window(x)
    return F.when(window.isNull(), "UNKNOWN").when(now < window["first"], "BEFORE").when(now > window["last"], "AFTER").otherwise("ACTIVE")


def freshness(made: Column, as_of: Column, stale_minutes: int = 1800, tolerance_minutes: int = 15) -> Column:
    """struct(freshness, age_minutes): INVALID without a time or from the future beyond the tolerance, STALE, or FRESH."""
    seconds = epoch_seconds(as_of) - epoch_seconds(made)
    age = F.greatest(F.lit(0), F.floor(seconds / 60))
    invalid = made.isNull() | (seconds < -60 * tolerance_minutes)
    label = F.when(invalid, "INVALID").when(age > stale_minutes, "STALE").otherwise("FRESH")
    return F.struct(label.alias("freshness"), F.when(~invalid, age).cast("long").alias("age_minutes"))


def lookback_windows(spark: SparkSession, first: str, last: str, days: int) -> DataFrame:
    """(first, last) of consecutive windows of so many days between two dates."""
    starts = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {days} DAYS"))).alias("first_day")
    whole = spark.range(1).select(starts)
    return whole.select("first_day", F.least(F.date_add("first_day", days - 1), F.lit(last).cast("date")).alias("last_day"))


def tick_grid(spark: SparkSession, day: str, first: str = "11:30", last: str = "19:00", minutes: int = 15) -> DataFrame:
    """Local ticks of a working day: number from 0, and the minute of the day."""
    minute = lambda s: int(s[:2]) * 60 + int(s[3:])
    ticks = spark.range(0, (minute(last) - minute(first)) // minutes + 1)
    at = F.lit(minute(first)) + F.col("id") * minutes
    return ticks.select(F.lit(day).alias("day"), F.col("id").cast("int").alias("tick"), at.cast("int").alias("minute_of_day"), F.format_string("%02d:%02d", F.floor(at / 60), at % 60).alias("clock"))


def scan_bucket(ts: Column, minutes: int) -> Column:
    """Number of the epoch-aligned bucket."""
    return F.floor(epoch_seconds(ts) / (60 * minutes)).cast("long")
