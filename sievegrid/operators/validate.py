"""Validation by codes: NULL is valid, the first failing check wins, bad rows go to a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_code(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fails; a check on NULL fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks])


def quarantined(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their error_code."""
    marked = df.withColumn("error_code", error_code(checks))
    return marked.where("error_code IS NULL").drop("error_code"), marked.where("error_code IS NOT NULL")


def filled(x: Column, kind: str) -> Column:
    """Text that is not blank, a collection that is not empty; 0 and false count as filled."""
    if kind == "string":
        return x.isNotNull() & (F.trim(x) != "")
    if kind.startswith(("array", "map")):
        return x.isNotNull() & (F.size(x) > 0)
    return x.isNotNull()


def unsupported(facts: dict[str, Column], evidence: Column) -> Column:
    """Sorted paths of filled facts without an evidence entry (struct with field_path)."""
    have = F.array_compact(F.array(*[F.when(ok, F.lit(path)) for path, ok in facts.items()]))
    return F.array_sort(F.array_except(have, F.transform(evidence, lambda e: e["field_path"])))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grounded(outputs: DataFrame, allowed: DataFrame, group: str, url: str, confidence: str, reason: str, kinds: list[str], kind: str) -> DataFrame:
    """Model outputs with the kind of rejection or NULL: address not allowed, enum, confidence, blank reason."""
    known = allowed.select(F.col(group), F.col(url)).distinct().withColumn("_known", F.lit(True))
    checks = [("URL_NOT_ALLOWED", F.col("_known")), ("KIND", F.col(kind).isin(kinds)), ("CONFIDENCE", F.col(confidence).between(0, 1)), ("REASON", F.trim(F.col(reason)) != "")]
    return outputs.join(known, [group, url], "left").withColumn("rejected", error_code(checks)).drop("_known")


def whole_list(items: Column, ok) -> Column:
    """All or nothing: every item passes and none comes twice."""
    return F.forall(items, ok) & (F.size(F.array_distinct(items)) == F.size(items))


# Kinds of sources, markets with name and administrative code, the facts that need evidence.
SOURCE_TYPES = ["CCGP_NOTICE", "OFFICIAL_INSTITUTION_NOTICE"]
MARKETS = {
    "BJ": ("北京", "110000"), "TJ": ("天津", "120000"), "HE": ("河北", "130000"), "LN": ("辽宁", "210000"), "JL": ("吉林", "220000"), "HL": ("黑龙江", "230000"),
}
REQUIRED_FACTS = ["project_name", "buyer_name", "notice_type", "published_at"]
CRITICAL_FACTS = [
    "project_number", "project_name", "buyer_name", "hospital_name", "department", "region", "lifecycle_state", "notice_type", "published_at", "registration_deadline",
    "registration_deadline_date", "bid_deadline", "expected_procurement_at", "budget_cny", "procurement_method", "product_categories", "product_items", "public_contact",
]
TRACKED_PATHS = ["facts.registration_deadline", "facts.bid_deadline"]
_INSTANT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def dateish(x: Column) -> Column:
    """An ISO date, or date and time with or without an offset, that the calendar has."""
    return x.rlike(_INSTANT) & F.substring(x, 1, 10).try_cast("date").isNotNull() & F.regexp_replace(x, "Z$", "+00:00").try_cast("timestamp").isNotNull()


def web_host(url: Column) -> Column:
    """The host of an https address, else NULL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)), F.lit(""))


def source_fault(kind: Column, url: Column, observed: Column) -> Column:
    """Kind of source, https address, host of the kind, time of observation."""
    h = web_host(url)
    return error_code([
        ("UNSUPPORTED_SOURCE_TYPE", kind.isin(SOURCE_TYPES)), ("SOURCE_URL_REQUIRED", F.trim(url) != ""), ("INVALID_SOURCE_URL", h.isNotNull()),
        ("CCGP_HOST_MISMATCH", (kind != "CCGP_NOTICE") | (h == "ccgp.gov.cn") | h.endswith(".ccgp.gov.cn")), ("SOURCE_OBSERVED_AT_REQUIRED", observed.isNotNull()), ("INVALID_DATE", dateish(observed)),
    ])


def evidence_fault(evidence: Column, kind: Column, url: Column) -> Column:
    """The first fault of the evidence list (field_path, source_url, locator): paths below facts, locators, allowed sources, no path twice.

    Evidence comes from the record's own page, or for an institution from any https page of its host.
    """
    own = F.coalesce(kind == "OFFICIAL_INSTITUTION_NOTICE", F.lit(False))
    allowed = lambda e: (e["source_url"] == url) | (own & (web_host(e["source_url"]) == web_host(url)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = lambda e: (
        F.when(~yes(F.startswith(e["field_path"], F.lit("facts."))), "EVIDENCE_FIELD_PATH_INVALID")
        .when(~yes(F.trim(e["locator"]) != ""), "EVIDENCE_LOCATOR_REQUIRED")
        .when(~yes(allowed(e)), "EVIDENCE_SOURCE_MISMATCH")
    )
    paths = F.transform(evidence, lambda e: e["field_path"])
    coded = F.transform(evidence, lambda e, i: F.coalesce(code(e), F.when(F.array_position(paths, e["field_path"]) <= i, "DUPLICATE_EVIDENCE_PATH")))
    return F.when(evidence.isNull(), "EVIDENCE_LIST_REQUIRED").otherwise(F.get(F.array_compact(coded), F.lit(0)))


def market_code(code: Column, default: str = "TJ") -> Column:
    return F.upper(F.trim(F.coalesce(F.nullif(code, F.lit("")), F.lit(default))))


def market_fault(code: Column, name: Column, admin: Column, default: str = "TJ") -> Column:
    """The market is known, and its name and administrative code, where given, are its own."""
    known = market_code(code, default)
    entry = lambda i: F.try_element_at(F.create_map(*[x for k, v in MARKETS.items() for x in (F.lit(k), F.lit(v[i]))]), known)
    return (
        F.when(~known.isin(list(MARKETS)), "MARKET_CODE_INVALID")
        .when(F.trim(name) != entry(0), "MARKET_NAME_MISMATCH")
        .when(F.trim(admin) != entry(1), "MARKET_ADMIN_CODE_MISMATCH")
    )


def record_fault(version: Column, key: Column, source: Column, facts: dict[str, tuple[str, Column]], evidence: Column) -> Column:
    """The first fault of a record, in a fixed order; NULL is valid.

    source: struct(source_type, url, observed_at). facts: name -> (type, column); facts that the table lacks are missing.
    Of facts without evidence the first by name is meant.
    """
    of = lambda k: facts[k][1] if k in facts else F.lit(None).cast("string")
    full = {k: filled(c, t) for k, (t, c) in facts.items()}
    missing = [F.when(~full.get(k, F.lit(False)), f"REQUIRED_FACT_MISSING:facts.{k}") for k in REQUIRED_FACTS]
    dates = [F.when(of(k).isNotNull() & ~F.coalesce(dateish(of(k)), F.lit(False)), f"INVALID_DATE:facts.{k}") for k in ("published_at", "registration_deadline", "bid_deadline", "expected_procurement_at")]
    day = of("registration_deadline_date")
    open_ = unsupported({f"facts.{k}": full[k] for k in CRITICAL_FACTS if k in full}, evidence)
    return F.coalesce(
        F.when(~F.coalesce(version == "0.1", F.lit(False)), "SCHEMA_VERSION_UNSUPPORTED"),
        F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "OPPORTUNITY_ID_REQUIRED"),
        source_fault(source["source_type"], source["url"], source["observed_at"]),
        market_fault(of("market_code"), of("market_name"), of("market_admin_code")),
        *missing,
        *dates,
        F.when(day.isNotNull() & ~F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.try_cast("date").isNotNull(), F.lit(False)), "INVALID_DATE_ONLY:facts.registration_deadline_date"),
        F.when(day.isNotNull() & of("registration_deadline").isNotNull(), "REGISTRATION_DEADLINE_PRECISION_CONFLICT"),
        F.when(of("budget_cny").cast("long") < 0, "INVALID_BUDGET_CNY"),
        evidence_fault(evidence, source["source_type"], source["url"]),
        F.when(F.size(open_) > 0, F.concat(F.lit("UNSUPPORTED_CRITICAL_FACT:"), F.get(open_, F.lit(0)))),
    )


def canonical_key(market: Column, number: Column, buyer: Column, name: Column, published: Column) -> Column:
    """What tells an opportunity apart: its number in its market, else buyer, name and date; in lower case."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    by_number = F.array(F.lit("project_number"), market_code(market), low(number))
    return F.when(low(number) != "", by_number).otherwise(F.array(F.lit("fallback"), market_code(market), low(buyer), low(name), F.trim(F.coalesce(published, F.lit("")))))


def event_fault(version: Column, key: Column, kind: Column, number: Column, published: Column, url: Column, hosts: list[str], changed: Column, overrides: Column, tracked: list[str] = TRACKED_PATHS) -> Column:
    """The first fault of a notice event: names, date, host, and overrides only of tracked paths said to change, as local instants."""
    paths = F.map_keys(F.coalesce(overrides, F.create_map().cast("map<string,string>")))
    values = F.map_values(F.coalesce(overrides, F.create_map().cast("map<string,string>")))
    return error_code([
        ("EVENT_SCHEMA_VERSION_UNSUPPORTED", version == "0.1"), ("EVENT_ID_REQUIRED", F.trim(key) != ""), ("EVENT_TYPE_INVALID", kind.isin("CORRECTION", "TERMINATION")),
        ("EVENT_PROJECT_NUMBER_REQUIRED", F.trim(number) != ""), ("EVENT_PUBLISHED_DATE_INVALID", published.rlike(r"^20\d{2}-\d{2}-\d{2}$")), ("EVENT_SOURCE_HOST_REJECTED", web_host(url).isin(hosts)),
        ("EVENT_FACT_OVERRIDE_PATH_INVALID", F.size(F.array_except(paths, F.array(*map(F.lit, tracked)))) == 0),
        ("EVENT_FACT_OVERRIDE_WITHOUT_CHANGE", F.size(F.array_except(paths, F.coalesce(changed, F.array().cast("array<string>")))) == 0),
        ("EVENT_FACT_OVERRIDE_VALUE_INVALID", F.forall(values, lambda v: F.coalesce(v.endswith("+08:00"), F.lit(False)))),
    ])


def duplicate_ids(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events with fault DUPLICATE_EVENT_ID on all rows of an id but its first; null ids are not told apart here."""
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    later = F.struct(*order) != F.col("_first")
    return events.join(first, key, "left").withColumn("fault", F.when(F.coalesce(later, F.lit(False)), "DUPLICATE_EVENT_ID")).drop("_first")
