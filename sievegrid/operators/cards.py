"""Cards as users see them: filters, orders, the watch list, combined pools, and the checks of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import any_term

# States of a follow-up and answers to a recommendation.
DONE_TODAY = ["CONTACTED", "NOT_FIT", "BID_SUBMITTED", "WON", "LOST", "ARCHIVED"]
ACTIVE = ["NEW", "REVIEWING", "CONTACTED", "RELATIONSHIP_VERIFIED", "PREPARING", "BID_SUBMITTED"]
CLOSED = ["WON", "LOST", "NOT_FIT", "ARCHIVED"]
MAX_POINTS = {
    "PRODUCT_EXECUTION_CAPABILITY": 25, "RELATIONSHIP": 10, "EXECUTION_FLEXIBILITY": 5, "INTERVENTION_STAGE": 25, "DEADLINE_URGENCY": 10, "PROJECT_AMOUNT": 10,
    "PRODUCT_SPECIFICITY": 8, "PUBLICATION_FRESHNESS": 7,
}
PRIVATE_COMPONENTS = ["PRODUCT_EXECUTION_CAPABILITY", "RELATIONSHIP", "EXECUTION_FLEXIBILITY"]
PUBLIC_SCORE_MAX = 60


def visible_today(status: Column, remind: Column, now: Column, done: list[str] = DONE_TODAY) -> Column:
    """Not done, and without a reminder or with one that is due; a card without a follow-up is visible."""
    return ~F.coalesce(status.isin(done), F.lit(False)) & (remind.isNull() | (remind <= now))


def attention_tier(status: Column, remind: Column, feedback: Column) -> Column:
    """0 for cards with an active follow-up or without feedback against them, 1 for known ones, 2 for ones of no value."""
    active = F.coalesce(status != "NEW", F.lit(False)) | remind.isNotNull()
    return F.when(active, 0).when(feedback == "NEW_NOT_VALUABLE", 2).when(feedback == "ALREADY_KNOWN", 1).otherwise(0)


def today(pool: DataFrame, followups: DataFrame, feedback: DataFrame, key: str, rank: str, now: Column, done: list[str] = DONE_TODAY) -> DataFrame:
    """The pool with each card's follow-up (status, remind_at) and feedback (value), without what is hidden today; place orders the rest by tier and rank."""
    f = followups.select(key, "status", "remind_at")
    v = feedback.select(key, "value")
    joined = pool.join(f, key, "left").join(v, key, "left")
    tier = attention_tier(F.col("status"), F.col("remind_at"), F.col("value"))
    seen = joined.where(visible_today(F.col("status"), F.col("remind_at"), now, done)).withColumn("tier", tier).where("tier < 2")
    return seen.withColumn("followup_status", F.coalesce("status", F.lit("NEW"))).drop("status")


def pre_market(lifecycle: Column, mode: Column) -> Column:
    return F.coalesce(mode == "PRE_MARKET_SIGNAL", F.lit(False)) | F.coalesce(F.upper(F.trim(lifecycle)) == "PROCUREMENT_INTENT", F.lit(False))


def pool_search(pool: DataFrame, market: Column, markets: list[str], mode: Column, lifecycle: Column, window: str, fields: list[Column], needle: str = "") -> DataFrame:
    """Cards of some markets in a window (ALL, OPEN, PRE_MARKET_SIGNAL, LATE_WINDOW) whose fields contain the needle in any case."""
    early = pre_market(lifecycle, mode)
    late = F.coalesce(mode == "LATE_WINDOW", F.lit(False))
    fits = {"OPEN": ~late & ~early, "PRE_MARKET_SIGNAL": early, "LATE_WINDOW": late}.get(window, F.lit(True))
    text = F.lower(F.array_join(F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != "")), " "))
    found = F.contains(text, F.lit(needle.strip().lower())) if needle.strip() else F.lit(True)
    return pool.where(market.isin(markets) & fits & found)


def followed_filter(status: Column, remind: Column, now: Column, wanted: str, active: list[str] = ACTIVE, closed: list[str] = CLOSED) -> Column:
    """The follow-ups of one tab: DUE, ACTIVE, MONITOR, WON, CLOSED, or all."""
    due = ~status.isin(closed) & remind.isNotNull() & (remind <= now)
    return {"DUE": due, "ACTIVE": status.isin(active), "MONITOR": status == "MONITOR", "WON": status == "WON", "CLOSED": status.isin(closed)}.get(wanted, F.lit(True))


def action_tier(status: Column, remind: Column, now: Column, active: list[str] = ACTIVE, closed: list[str] = CLOSED) -> Column:
    """0 due, 1 with a later reminder, 2 active, 3 watched, 4 the rest."""
    open_ = ~F.coalesce(status.isin(closed), F.lit(False))
    return F.when(open_ & (remind <= now), 0).when(open_ & remind.isNotNull(), 1).when(status.isin(active), 2).when(status == "MONITOR", 3).otherwise(4)


def action_order(status: Column, remind: Column, updated: Column, now: Column, active: list[str] = ACTIVE, closed: list[str] = CLOSED, pinned: Column | None = None) -> list[Column]:
    """The pinned row, then by tier, the earlier reminder in the first two, the latest change."""
    tier = action_tier(status, remind, now, active, closed)
    first = [] if pinned is None else [F.coalesce(pinned, F.lit(False)).desc()]
    return [*first, tier.asc(), F.when(tier <= 1, remind).asc_nulls_last(), updated.desc()]


def intent_order(has_successor: Column, phase: Column, published: Column) -> list[Column]:
    """Intents with a formal successor first, then by phase (over, now, ahead, unknown), the newest first."""
    place = F.when(phase == "AFTER", 0).when(phase == "ACTIVE", 1).when(phase == "BEFORE", 2).otherwise(3)
    return [has_successor.desc(), place.asc(), published.desc()]


def due_reminders(followups: DataFrame, user: str, remind: str, tie: str, now: Column, status: str, closed: list[str] = CLOSED, most: int = 20) -> DataFrame:
    """Each user's reminders that are due, the earliest first, so many at most."""
    due = followups.where((F.col(remind) <= now) & ~F.col(status).isin(closed))
    place = F.row_number().over(Window.partitionBy(user).orderBy(remind, tie))
    return due.withColumn("place", place).where(F.col("place") <= most)


def watch_list(records: DataFrame, kind: Column, in_scope: Column, number: Column, deadline: Column, as_of: Column, wanted_kind: str = "CCGP_NOTICE") -> DataFrame:
    """Distinct project numbers of notices in scope whose deadline is unknown or ahead."""
    open_ = deadline.isNull() | (deadline > as_of)
    named = F.trim(number)
    return records.where((kind == wanted_kind) & in_scope & open_ & (named != "")).select(named.alias("project_number")).distinct()


def recall_exclusion(hard: Column, generic: Column, strong: Column) -> Column:
    """What excludes a mere title: a hard term, or a general one without any strong term."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(hard) | (yes(generic) & ~yes(strong))


def skip_reason(title: Column, kind: Column, excluded: Column, single_source: tuple[str, ...] = ("单一来源", "采购实行单一来源采购方式")) -> Column:
    """Why a candidate is left out, or NULL."""
    said = F.concat_ws("\n", title, kind)
    return F.when(said.rlike(any_term(list(single_source))), "NON_COMPETITIVE_SINGLE_SOURCE").when(F.coalesce(excluded, F.lit(False)), "OUT_OF_MEDICAL_SCOPE")


def candidate_priority(in_scope: Column, has_context: Column, broad: Column) -> Column:
    """3 in scope, 2 with context and a broad term, else 1."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(in_scope), 3).when(yes(has_context) & yes(broad), 2).otherwise(1)


def date_window(df: DataFrame, day: Column, first: Column, last: Column, order: list[Column], most: int) -> DataFrame:
    """Rows of a span of days, in order, so many at most."""
    return df.where(day.between(first, last)).orderBy(*order).limit(most)


def selected_candidates(df: DataFrame, market: str, url: str, known: DataFrame, known_url: str, priority: str, published: str, most: int) -> DataFrame:
    """Per market the first candidates, addresses that no record has yet before all others, then by priority, date and address, all descending."""
    seen = known.select(F.col(known_url).alias(url)).distinct().withColumn("_seen", F.lit(True))
    joined = df.join(seen, url, "left").withColumn("unseen", F.col("_seen").isNull() & (F.coalesce(url, F.lit("")) != "")).drop("_seen")
    order = [F.col("unseen").desc(), F.col(priority).desc(), F.coalesce(published, F.lit("")).desc(), F.col(url).desc()]
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(market).orderBy(*order))).where(F.col("place") <= most)


def with_market(cards: DataFrame, records: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Cards with the market fields of their record; of records with one id the last counts, and cards without one keep what they have."""
    last = records.groupBy(key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_r"))
    joined = cards.join(last, key, "left")
    return joined.select(*[F.coalesce(F.col("_r")[c], F.col(c)).alias(c) if c in values else F.col(c) for c in cards.columns], *[F.col("_r")[v].alias(v) for v in values if v not in cards.columns])


def combined_pool(parts: list[DataFrame], key: str, order: list[Column], most: int | None = None) -> DataFrame:
    """Cards of several snapshots, the best by order of each id, ranked anew; cards without an id are left out."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = both.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_p = 1").drop("_p")
    from sievegrid.operators.ranking import top

    if most is not None:
        return top(best, order, most)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def priority_fault(components: Column, score: Column, most: dict[str, int] = MAX_POINTS, private: list[str] = PRIVATE_COMPONENTS, cap: int = PUBLIC_SCORE_MAX) -> Column:
    """The first fault of a public score's components (code, points, max_points), or NULL: each code once with its own
    maximum, points within it, none for private parts, and their sum is the score."""
    codes = F.transform(components, lambda c: c["code"])
    limit = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])
    ours = F.array(*[F.lit(k) for k in sorted(most)])
    bad = F.exists(components, lambda c: F.coalesce(F.try_element_at(limit, c["code"]).isNull() | (c["max_points"] != F.try_element_at(limit, c["code"])) | ~c["points"].between(0, F.try_element_at(limit, c["code"])), F.lit(True)))
    mine = F.exists(components, lambda c: c["code"].isin(private) & (c["points"] != 0))
    sum_ = F.aggregate(components, F.lit(0), lambda a, c: a + c["points"].cast("int"))
    return (
        F.when(components.isNull() | (F.size(components) != len(most)), "PRIORITY_COMPONENTS_INVALID")
        .when(F.array_sort(codes) != ours, "PRIORITY_COMPONENT_INVALID")
        .when(bad, "PRIORITY_COMPONENT_INVALID")
        .when(mine, "PRIVATE_SCORE_PRESENT")
        .when(score.isNull() | (score != sum_) | ~score.between(0, cap), "PRIORITY_SCORE_INVALID")
    )


def card_fault(key: Column, verified: Column, urls: Column, fault: Column) -> Column:
    """The first fault of a card, or NULL: id, verification, https evidence, then its priority's own."""
    https = F.size(F.coalesce(urls, F.array().cast("array<string>"))) > 0
    https = https & F.forall(urls, lambda u: F.coalesce(u.rlike(r"(?i)^https://[^/?#\s]+"), F.lit(False)))
    return (
        F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "CARD_INVALID")
        .when(~F.coalesce(verified == "VERIFIED", F.lit(False)), "CARD_NOT_VERIFIED")
        .when(~F.coalesce(https, F.lit(False)), "EVIDENCE_INVALID")
        .otherwise(fault)
    )


def forbidden_paths(schema, forbidden: list[str], prefixes: list[str], path: str = "$") -> list[str]:
    """Paths of a schema's fields, at any depth, with a forbidden name or a name that begins so."""
    from pyspark.sql import types as T

    if isinstance(schema, T.ArrayType):
        return forbidden_paths(schema.elementType, forbidden, prefixes, f"{path}[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema:
        name = f.name.lower()
        if name in forbidden or any(name.startswith(p) for p in prefixes):
            out.append(f"{path}.{f.name}")
        out += forbidden_paths(f.dataType, forbidden, prefixes, f"{path}.{f.name}")
    return out


def snapshot_faults(cards: DataFrame, pool: DataFrame, key: str, card_count: int, pool_count: int, matched: int, most_cards: int = 5, most_pool: int = 500) -> DataFrame:
    """Codes of all that is wrong with a snapshot's lists: sizes, counts, repeated ids, cards that the pool lacks."""
    n = lambda d, name: d.agg(F.count("*").alias(f"{name}_n"), F.count_distinct(key).alias(f"{name}_ids"))
    outside = cards.select(key).join(pool.select(key), key, "left_anti").agg(F.count("*").alias("outside"))
    whole = n(cards, "c").crossJoin(n(pool, "p")).crossJoin(outside)  # three tables of one row
    rules = {
        "CARDS_INVALID": F.col("c_n") > most_cards, "CARD_COUNT_MISMATCH": F.col("c_n") != card_count, "DUPLICATE_TOP5_ID": F.col("c_n") != F.col("c_ids"),
        "POOL_INVALID": F.col("p_n") > most_pool, "DUPLICATE_POOL_ID": F.col("p_n") != F.col("p_ids"), "POOL_COUNT_MISMATCH": F.col("p_n") != pool_count,
        "MATCHED_COUNT_MISMATCH": F.col("p_n") != matched, "TOP5_NOT_IN_POOL": F.col("outside") > 0,
    }
    return whole.select(F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))).alias("fault"))


def allowed_actions(evidence: Column, has_contact: Column, window: Column, relative_flag: Column, confirmed: Column) -> Column:
    """Codes of actions that a card's facts allow."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    https = F.exists(evidence, lambda u: u.rlike("(?i)^https://"))
    rules = [
        ("VERIFY_REQUIREMENTS", F.lit(True)), ("REVIEW_OFFICIAL_SOURCE", yes(https)), ("CONTACT_PUBLIC_CONTACT", yes(has_contact)),
        ("PREPARE_REQUIRED_MATERIALS", window.isin("OPEN", "RELATIVE_WINDOW")), ("CONFIRM_RELATIVE_WINDOW", (window == "RELATIVE_WINDOW") & yes(relative_flag)),
        ("CHECK_LATE_WINDOW_OPTIONS", window == "LATE_WINDOW"), ("MATCH_CONFIRMED_RESOURCES", yes(confirmed)),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


def decision_fault(codes: Column, allowed: Column, most: int = 3) -> Column:
    """One to three distinct codes, all of them allowed; the first rule that a list breaks, or NULL."""
    return (
        F.when(codes.isNull() | ~F.size(codes).between(1, most), "AI_DECISION_INVALID")
        .when(F.exists(codes, lambda c: F.coalesce(F.trim(c) == "", F.lit(True))), "AI_DECISION_INVALID")
        .when(F.size(F.array_distinct(codes)) != F.size(codes), "AI_DECISION_DUPLICATE_ACTION")
        .when(F.size(F.array_except(codes, allowed)) > 0, "AI_DECISION_ACTION_NOT_GROUNDED")
    )


def mutation_valid(status: Column, mutation: Column, reason: Column, remind: Column, states: list[str], reasons: list[str], terminal: list[str]) -> Column:
    """A follow-up's change: known state, well-formed id, a reason exactly for NOT_FIT, no reminder on a state that ends it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    given = F.nullif(F.trim(reason), F.lit(""))
    known = yes(status.isin(states)) & yes(F.trim(mutation).rlike("^followup:[0-9a-fA-F-]{36}$"))
    fits = F.when(status == "NOT_FIT", yes(given.isin(reasons))).otherwise(given.isNull())
    return known & fits & ~(yes(status.isin(terminal)) & remind.isNotNull())


def intent_summary(cards: DataFrame, pairs: DataFrame, is_intent: Column) -> DataFrame:
    """Intents, those of them with a formal successor, and the pairs."""
    found = pairs.agg(F.count_distinct("intent_key").alias("intents_with_formal_successor"), F.count("*").alias("candidate_pair_count"))
    return cards.agg(F.count_if(is_intent).alias("intent_count")).crossJoin(found)  # two tables of one row


def region_groups(observations: DataFrame, region: str, key: str, mark: str) -> DataFrame:
    """Observations by region with their number and a hash over (key, mark) in the keys' order."""
    rows = observations.groupBy(region).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct(key, mark))).alias("_r"))
    shown = F.array_join(F.transform("_r", lambda r: F.concat(r[key].cast("string"), F.lit(":"), r[mark].cast("string"))), "\n")
    return rows.select(region, "n_rows", F.sha2(shown, 256).alias("group_hash"))


def directed_tasks(intents: DataFrame, key: str, published: str, sources: Column, keyword: Column, adapters: list[str], most: int) -> DataFrame:
    """Tasks of the newest intents, one per official source, so many at most; READY where the source has an adapter and there is a keyword."""
    spread = intents.select(key, published, keyword.alias("search_keyword"), F.posexplode(F.array_distinct(sources)).alias("_place", "source"))
    first = spread.orderBy(F.desc(published), F.desc(key), "_place").limit(most)
    ready = F.col("source").isin(adapters) & F.col("search_keyword").isNotNull()
    return first.select(key, "source", "search_keyword", F.when(ready, "READY").otherwise("UNSUPPORTED_SOURCE_ADAPTER").alias("status"))


def search_keyword(items: Column, subject: Column, generic: list[str], least: int = 2, most: int = 60) -> Column:
    """The first item's name that is neither general nor of an odd length, else the project's subject without its ending."""
    fits = lambda x: F.length(x).between(least, most) & ~x.isin(generic)
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    named = F.filter(F.transform(items, lambda i: F.btrim(bare(i), F.lit("：:，,。；; "))), fits)
    told = F.regexp_replace(bare(F.regexp_replace(F.trim(subject), r"^采购意向公告（[^）]+）\s*[-—]\s*", "")), "(?:采购项目|项目)$", "")
    return F.coalesce(F.get(named, F.lit(0)), F.when(fits(told), told))
