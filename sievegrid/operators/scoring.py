"""Actionability and the parts of a score, as column expressions with their thresholds as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.text import acronym_pattern, any_term, match_key

# Fixed values: (at most so many hours or days, points) in order, then what is beyond; for amounts (at least so much, points).
DEADLINE_HOURS, DEADLINE_LATER, DEADLINE_NONE = [(24, 10), (72, 9), (168, 7), (336, 5), (720, 3)], 1, 0
AMOUNTS = [(5_000_000, 10), (3_000_000, 9), (1_000_000, 7), (500_000, 4)]
AGE_DAYS = [(1, 7), (3, 6), (7, 5), (14, 3), (30, 1)]
RELATIONSHIPS = {"STRONG": 10, "MEDIUM": 7, "HISTORICAL": 4, "WEAK": 2}
CAPABILITIES = {
    "DIRECT_AUTHORIZED": 25, "RENTAL_CAPABLE": 22, "DIRECT": 18, "DIRECT_UNCONFIRMED": 18,
    "NEED_MANUFACTURER": 14, "CAN_SOURCE_PARTNER": 14, "PARTNER": 12, "SERVICE_ONLY": 8,
}
TIERS = [(90, "critical"), (75, "high"), (60, "medium")]
PRODUCT_ACRONYMS = ["CT", "DR", "MRI", "DSA", "PCR", "POCT", "IVD", "LIS", "PACS", "RIS", "HIS", "GPU"]
PRODUCT_TERMS = [
    "数字减影血管造影", "血管造影机", "磁共振", "彩色超声", "超声诊断", "胃肠动力", "X线", "X光机", "内窥镜", "内镜", "质谱", "测序", "透析", "呼吸机", "心电", "脑电",
    "病理", "生化分析", "免疫分析", "血液分析", "采血", "检验科设备", "实验室设备",
]
LEASE_TERMS = ["租赁", "租用", "租机"]


def ladder(x: Column, steps: list[tuple[float, int]], beyond: int = 0, missing: int = 0) -> Column:
    """Points of the first step that x does not exceed."""
    out = reduce(lambda rest, s: F.when(x <= s[0], s[1]).otherwise(rest), reversed(steps), F.lit(beyond))
    return F.when(x.isNull(), missing).otherwise(out).cast("int")


def actionability(as_of: Column, today: Column, lifecycle: Column, bid: Column, registration: Column, registration_day: Column, relative: Column, served: bool = False) -> Column:
    """struct(mode, points, status): intent, bid closed, registration closed, registration day over, relative window over, open.

    A deadline equal to as_of is closed; today is the local day of as_of. The day counts only where no
    registration instant is known. served: leave out the intent branch, as a served card does.
    """
    said = lambda mode, points, status: F.struct(F.lit(mode).alias("mode"), F.lit(points).alias("points"), F.lit(status).alias("status"))
    archive = said("ARCHIVE", 0, "NOT_ELIGIBLE")
    shut = (registration <= as_of) | (registration.isNull() & (registration_day < today))
    rules = [] if served else [(lifecycle == "PROCUREMENT_INTENT", said("PRE_MARKET_SIGNAL", 12, "AWAITING_MODEL"))]
    rules += [
        (bid <= as_of, archive),
        (shut, F.when(bid.isNull(), archive).otherwise(said("LATE_WINDOW", 8, "AWAITING_MODEL"))),
        (relative <= as_of, archive),
    ]
    return reduce(lambda rest, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(rest), reversed(rules), said("PUBLIC_OPPORTUNITY", 25, "AWAITING_MODEL"))


def next_deadline(as_of: Column, today: Column, bid: Column, registration: Column, registration_day: Column, day_end: Column, relative: Column) -> Column:
    """The deadline to act on: registration, else its day's end (where no instant is known), else bid, else the relative window's end."""
    by_day = registration.isNull() & (registration_day >= today)
    return F.coalesce(F.when(registration > as_of, registration), F.when(by_day, day_end), F.when(bid > as_of, bid), F.when(relative > as_of, relative))


def window_status(as_of: Column, today: Column, bid: Column, registration: Column, registration_day: Column, relative_flag: Column, relative_day: Column) -> Column:
    """CLOSED, LATE_WINDOW, RELATIVE_WINDOW or OPEN; a relative window counts only where nothing else is known.

    relative_day: the last day of the relative window, NULL where its start is unknown.
    """
    shut = F.coalesce(registration_day < today, F.lit(False)) | F.coalesce(registration <= as_of, F.lit(False))
    nothing = registration.isNull() & registration_day.isNull() & bid.isNull()
    return (
        F.when(bid <= as_of, "CLOSED")
        .when(bid.isNull() & shut, "CLOSED")
        .when(shut, "LATE_WINDOW")
        .when(nothing & F.coalesce(relative_flag, F.lit(False)), F.when(relative_day.isNull() | (today > relative_day), "CLOSED").otherwise("RELATIVE_WINDOW"))
        .otherwise("OPEN")
    )


def deadline_points(hours: Column) -> Column:
    """Points of the hours left; an expired deadline has none."""
    return F.when(hours < 0, 0).otherwise(ladder(hours, DEADLINE_HOURS, DEADLINE_LATER, DEADLINE_NONE)).cast("int")


def amount_points(amount: Column, steps: list[tuple[float, int]] = AMOUNTS, some: int = 2) -> Column:
    """Points of the highest step that the amount reaches."""
    out = F.when(amount > 0, some).otherwise(0)
    for least, points in reversed(steps):
        out = F.when(amount >= least, points).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("int")


def freshness_points(days: Column) -> Column:
    return F.when(days < 0, 0).otherwise(ladder(days, AGE_DAYS)).cast("int")


def specific_title(title: Column) -> Column:
    """The title names a product family."""
    return F.coalesce(title.rlike(acronym_pattern(PRODUCT_ACRONYMS)) | title.rlike(any_term(PRODUCT_TERMS)), F.lit(False))


def specificity_points(has_items: Column, has_category: Column, conflict: Column, has_department: Column, has_method: Column, title: Column | None = None, most: int = 8) -> Column:
    """Items, or else a title that names a product family; a category unless it conflicts with the title; department; method."""
    if title is not None:
        has_items = F.coalesce(has_items, F.lit(False)) | specific_title(title)
    said = F.when(has_items, 4).otherwise(0) + F.when(has_category & ~conflict, 2).otherwise(0) + F.when(has_department, 1).otherwise(0) + F.when(has_method, 1).otherwise(0)
    return F.least(said, F.lit(most)).cast("int")


def relationship_points(strength: Column, points: dict[str, int] = RELATIONSHIPS) -> Column:
    return reduce(lambda rest, kv: F.when(strength == kv[0], kv[1]).otherwise(rest), points.items(), F.lit(0)).cast("int")


def capability_points(kind: Column, points: dict[str, int] = CAPABILITIES) -> Column:
    return relationship_points(kind, points)


def lease_wanted(title: Column, method: Column, categories: Column, conflict: Column) -> Column:
    """The project is a lease by its title, method or, unless they conflict with the title, its categories."""
    said = F.concat_ws(" ", title, method, F.when(~F.coalesce(conflict, F.lit(False)), F.array_join(categories, " ")))
    return match_key(said).rlike(any_term(LEASE_TERMS))


def private_points(kinds: Column, strength: Column, lease: Column, find_manufacturer: Column, partner_channel: Column, handle_lease: Column) -> Column:
    """struct(capability, relationship, flexibility) from the kinds of the matching capabilities (an array), the
    best relationship and three answers that may be NULL; a mere target counts for nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda *names: F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names])), F.lit(False))
    flexibility = F.greatest(
        F.when((yes(lease) | has("RENTAL_CAPABLE")) & yes(handle_lease), 5).otherwise(0),
        F.when(has("NEED_MANUFACTURER", "CAN_SOURCE_PARTNER") & yes(find_manufacturer), 3).otherwise(0),
        F.when(has("PARTNER", "CAN_SOURCE_PARTNER") & yes(partner_channel), 3).otherwise(0),
        F.when(has("CAN_SOURCE_PARTNER") & yes(find_manufacturer) & yes(partner_channel), 5).otherwise(0),
    )
    best = F.coalesce(F.array_max(F.transform(kinds, lambda k: capability_points(k))), F.lit(0))
    return F.struct(best.cast("int").alias("capability"), relationship_points(strength).alias("relationship"), flexibility.cast("int").alias("flexibility"))


def rescored(components: Column, fresh: dict[str, Column], most: dict[str, int]) -> Column:
    """Components struct(code, points) with the given ones replaced and held between 0 and their most."""

    def points(c: Column) -> Column:
        out = c["points"]
        for code, p in fresh.items():
            out = F.when(c["code"] == code, F.greatest(F.lit(0), F.least(F.lit(most[code]), p))).otherwise(out)
        return out.cast("int")

    return F.transform(components, lambda c: F.struct(c["code"].alias("code"), points(c).alias("points")))


def total(components: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(components, F.lit(0), lambda a, c: a + c["points"])))


def personalised(score: Column, old_private: Column, private: Column) -> Column:
    """The public part, without what was private in it, plus the private points; 100 at most."""
    return F.least(F.lit(100), F.greatest(F.lit(0), score - old_private) + private).cast("int")


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage, half up; NULL of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).cast("long")


def tier(score: Column) -> Column:
    return reduce(lambda rest, t: F.when(score >= t[0], t[1]).otherwise(rest), reversed(TIERS), F.lit("low"))


def percent_points(shown: Column, most: int) -> Column:
    """Points that a percentage of their most stands for, half up, held between 0 and the most; 0 of none or no finite one."""
    finite = shown.isNotNull() & ~F.isnan(shown.cast("double")) & (F.abs(shown) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0), F.least(F.lit(most), F.floor(shown / 100.0 * most + 0.5)))).otherwise(0).cast("int")


def points_percent(points: Column, most: int) -> Column:
    """The percentage of the most that points are, half up, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(points / float(most) * 100 + 0.5))).cast("int")


def refreshed(score: Column, shown: dict[str, Column], fresh: dict[str, Column], most: dict[str, int]) -> Column:
    """struct(score, percentages): a score whose components are shown as percentages, after some get fresh points."""
    change = F.lit(0)
    for code, points in fresh.items():
        change = change - percent_points(shown[code], most[code]) + points
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score + change)).cast("int").alias("score"), *[points_percent(p, most[c]).alias(c) for c, p in fresh.items()])
