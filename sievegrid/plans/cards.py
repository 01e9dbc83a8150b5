"""Queries of cards, customers' own lists and validators over whole driver tables, each with its SQL in DuckDB's dialect.

Orders stand for opportunities: what a column means is said once, in _cards and in _CARDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text, times
from sievegrid.operators import analytics, cards, ledger, merge, profile, ranking, scoring, validate
from sievegrid.plans.notices import _rows
from sievegrid.plans.tables import _events, _table

#: 2001-07-15 08:00 in Shanghai.
NOW, TODAY = 995_155_200, "2001-07-15"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k, published = F.col("o_orderkey"), times.epoch_seconds(F.col("o_orderdate"))
    days = (k % 40).cast("int")
    day = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("amount"), published.alias("published"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
        F.when(k % 11 == 0, "PROCUREMENT_INTENT").otherwise("BIDDING").alias("lifecycle"),
        F.when(k % 5 < 3, published + (k % 90) * 86_400).alias("bid"),
        F.when(k % 3 == 0, published + days * 86_400 + 3600).alias("registration"),
        F.when(k % 3 == 1, F.date_add(day, days)).alias("registration_day"),
        F.when(k % 4 == 0, F.date_add(day, 7)).alias("relative_day"),
    )


def _day_end(day: Column) -> Column:
    """The last second of a day in Shanghai."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + 86_399 - 28_800


_CARDS = f"""
    card AS (
        SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice AS amount, {NOW} AS now_s, DATE '{TODAY}' AS today, epoch_us(o_orderdate) // 1000000 AS published, o_orderdate::DATE AS pub_day,
               CASE WHEN o_orderkey % 11 = 0 THEN 'PROCUREMENT_INTENT' ELSE 'BIDDING' END AS lifecycle,
               CASE WHEN o_orderkey % 5 < 3 THEN published + (o_orderkey % 90) * 86400 END AS bid,
               CASE WHEN o_orderkey % 3 = 0 THEN published + (o_orderkey % 40) * 86400 + 3600 END AS reg,
               CASE WHEN o_orderkey % 3 = 1 THEN pub_day + (o_orderkey % 40)::INT END AS reg_day,
               CASE WHEN o_orderkey % 4 = 0 THEN pub_day + 7 END AS rel_day,
               epoch(reg_day)::BIGINT + 57599 AS reg_end, epoch(rel_day)::BIGINT + 57599 AS rel_end
        FROM orders),
    judged AS (
        SELECT *, reg <= now_s OR (reg IS NULL AND reg_day < today) AS shut, coalesce(reg <= now_s, false) OR coalesce(reg_day < today, false) AS shut_any,
               CASE WHEN lifecycle = 'PROCUREMENT_INTENT' THEN 'PRE_MARKET_SIGNAL' WHEN bid <= now_s THEN 'ARCHIVE' WHEN shut THEN CASE WHEN bid IS NULL THEN 'ARCHIVE' ELSE 'LATE_WINDOW' END
                    WHEN rel_end <= now_s THEN 'ARCHIVE' ELSE 'PUBLIC_OPPORTUNITY' END AS mode,
               CASE WHEN bid <= now_s THEN 'ARCHIVE' WHEN shut THEN CASE WHEN bid IS NULL THEN 'ARCHIVE' ELSE 'LATE_WINDOW' END
                    WHEN rel_end <= now_s THEN 'ARCHIVE' ELSE 'PUBLIC_OPPORTUNITY' END AS served_mode,
               CASE WHEN bid <= now_s OR (bid IS NULL AND shut_any) THEN 'CLOSED' WHEN shut_any THEN 'LATE_WINDOW'
                    WHEN reg IS NULL AND reg_day IS NULL AND bid IS NULL AND rel_day IS NOT NULL THEN CASE WHEN today > rel_day THEN 'CLOSED' ELSE 'RELATIVE_WINDOW' END ELSE 'OPEN' END AS win,
               CASE WHEN reg > now_s THEN reg WHEN reg IS NULL AND reg_day >= today THEN reg_end WHEN bid > now_s THEN bid WHEN rel_end > now_s THEN rel_end END AS next_deadline,
               (next_deadline - now_s) / 3600.0 AS hours, date_diff('day', pub_day, today) AS age
        FROM card),
    scored AS (
        SELECT *, CASE mode WHEN 'PUBLIC_OPPORTUNITY' THEN 25 WHEN 'PRE_MARKET_SIGNAL' THEN 12 WHEN 'LATE_WINDOW' THEN 8 ELSE 0 END AS p_stage,
               CASE WHEN hours IS NULL OR hours < 0 THEN 0 WHEN hours <= 24 THEN 10 WHEN hours <= 72 THEN 9 WHEN hours <= 168 THEN 7 WHEN hours <= 336 THEN 5 WHEN hours <= 720 THEN 3 ELSE 1 END AS p_urgency,
               CASE WHEN amount >= 5000000 THEN 10 WHEN amount >= 3000000 THEN 9 WHEN amount >= 1000000 THEN 7 WHEN amount >= 500000 THEN 4 WHEN amount > 0 THEN 2 ELSE 0 END AS p_amount,
               CASE WHEN age < 0 THEN 0 WHEN age <= 1 THEN 7 WHEN age <= 3 THEN 6 WHEN age <= 7 THEN 5 WHEN age <= 14 THEN 3 WHEN age <= 30 THEN 1 ELSE 0 END AS p_fresh,
               (p_stage + p_urgency + p_amount + p_fresh)::INT AS score,
               CASE WHEN hours IS NULL THEN 'NO_DEADLINE' WHEN hours <= 24 THEN 'H24' WHEN hours <= 72 THEN 'H72' WHEN hours <= 168 THEN 'D7' WHEN hours <= 336 THEN 'D14' WHEN hours <= 720 THEN 'D30' ELSE 'GT30D' END AS bucket,
               CASE WHEN score * 2 >= 90 THEN 'critical' WHEN score * 2 >= 75 THEN 'high' WHEN score * 2 >= 60 THEN 'medium' ELSE 'low' END AS tier
        FROM judged)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cards(spark, sf_dir)
    now, today = F.lit(NOW).cast("long"), F.lit(TODAY).cast("date")
    bid, reg, day, rel = F.col("bid"), F.col("registration"), F.col("registration_day"), F.col("relative_day")
    c = c.withColumns({
        "a": scoring.actionability(now, today, F.col("lifecycle"), bid, reg, day, _day_end(rel)),
        "s": scoring.actionability(now, today, F.col("lifecycle"), bid, reg, day, _day_end(rel), served=True),
        "win": scoring.window_status(now, today, bid, reg, day, rel.isNotNull(), rel),
        "next_deadline": scoring.next_deadline(now, today, bid, reg, day, _day_end(day), _day_end(rel)),
    })
    hours = (F.col("next_deadline") - now) / 3600
    c = c.withColumns({
        "p_stage": F.col("a.points"), "p_urgency": scoring.deadline_points(hours), "p_amount": scoring.amount_points(F.col("amount")),
        "p_fresh": scoring.freshness_points(F.datediff(today, F.col("published_at").cast("date"))), "bucket": times.urgency(hours),
    })
    c = c.withColumn("score", F.expr("p_stage + p_urgency + p_amount + p_fresh").cast("int"))
    return c.withColumn("tier", scoring.tier(F.col("score") * 2)).withColumns({"mode": F.col("a.mode"), "status": F.col("a.status"), "served_mode": F.col("s.mode")})


def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("o_orderkey", "mode", "status", "served_mode", "win", "next_deadline", "p_stage", "p_urgency", "p_amount", "p_fresh", "score", "bucket", "tier")


def combined_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pools that share customers: the best card of each customer, in the pool's order."""
    c = _scored(spark, sf_dir).where("mode <> 'ARCHIVE'").select("o_custkey", "o_orderkey", "score", "next_deadline", "published")
    order = [F.col("score").desc(), F.col("next_deadline").asc_nulls_last(), F.col("published").desc(), F.col("o_orderkey").asc()]
    return cards.combined_pool([c.where("o_orderkey % 2 = 0"), c.where("o_orderkey % 2 = 1")], "o_custkey", order, 500).select("rank", "o_custkey", "o_orderkey", "score")


def _followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' first lines as follow-ups, their ship dates as reminders."""
    line = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")).alias("l")).select("l_orderkey", "l.*")
    state = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "WON").otherwise("LOST")).when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", "REVIEWING").otherwise("MONITOR")).otherwise("NEW")
    return line.select(F.col("l_orderkey").alias("o_orderkey"), state.alias("status"), F.when(F.col("l_quantity") > 25, times.epoch_seconds(F.col("l_shipdate"))).alias("remind_at"), (F.col("l_suppkey") * 1000 + F.col("l_orderkey")).alias("updated"))


_FOLLOWUPS = """
    firsts AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_shipdate) = 1),
    fu AS (
        SELECT l_orderkey AS o_orderkey, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'WON' WHEN 'AO' THEN 'LOST' WHEN 'NF' THEN 'REVIEWING' WHEN 'NO' THEN 'MONITOR' ELSE 'NEW' END AS status,
               CASE WHEN l_quantity > 25 THEN epoch_us(l_shipdate) // 1000000 END AS remind_at, l_suppkey * 1000 + l_orderkey AS updated FROM firsts)"""


def today_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is visible today, with the tier of attention."""
    pool = _scored(spark, sf_dir).select("o_orderkey", "score")
    feedback = _table(spark, sf_dir, "orders").where("o_orderkey % 7 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "NEW_NOT_VALUABLE").otherwise("ALREADY_KNOWN").alias("value"))
    return cards.today(pool, _followups(spark, sf_dir), feedback, "o_orderkey", "score", F.lit(NOW)).select("o_orderkey", "followup_status", "remind_at", "tier")


def followed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the follow-ups in the order of the action view, the first five, and which tabs show them."""
    f = _followups(spark, sf_dir).join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    now, status, remind = F.lit(NOW), F.col("status"), F.col("remind_at")
    order = [*cards.action_order(status, remind, F.col("updated"), now), F.col("o_orderkey")]
    tabs = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(cards.followed_filter(status, remind, now, t), F.lit(False)), F.lit(t)) for t in ("DUE", "ACTIVE", "MONITOR", "WON", "CLOSED")])), ",")
    ranked = ranking.ranked_within(f, ["o_custkey"], order, 5, "place")
    return ranked.select("o_custkey", "o_orderkey", "place", cards.action_tier(status, remind, now).alias("tier"), tabs.alias("tabs"))


def due_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _followups(spark, sf_dir).join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    due = cards.due_reminders(f, "o_custkey", "remind_at", "o_orderkey", F.lit(NOW), "status", most=20)
    return due.select("o_custkey", "o_orderkey", "place", text.reminder_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("remind_at").cast("string")).alias("reminder_id"))


def pool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scored(spark, sf_dir).join(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = []
    for window in ("OPEN", "PRE_MARKET_SIGNAL", "LATE_WINDOW"):
        found = cards.pool_search(c, F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], F.col("mode"), F.col("lifecycle"), window, [F.col("c_name"), F.col("c_mktsegment")], " CUSTOMER#00000001 ")
        out.append(found.select("o_orderkey", F.lit(window).alias("shown_in")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def selected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as candidates of the market that their address ends in; those with an even number are known already."""
    p = _table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(text.host(F.col("url")), r"([a-z]+)$", 1).alias("market"), F.lpad((F.col("page_id") % 50).cast("string"), 3, "0").alias("published"))
    p = p.withColumn("priority", cards.candidate_priority(F.contains("url", F.lit("blog")), F.contains("url", F.lit("/en/")), F.startswith("url", F.lit("https"))))
    known = p.where("page_id % 2 = 0")
    return cards.selected_candidates(p, "market", "url", known, "url", "priority", "published", 40).select("market", "url", "page_id", "priority", "unseen", "place")


def capability_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' capabilities by keyword against the names of parts, the newest two a part and owner."""
    s = _table(spark, sf_dir, "supplier").withColumn("n", F.row_number().over(_by_key("s_suppkey")))
    words = F.element_at(F.array(*[F.lit(w) for w in ("Bolt", "red widget", "ct", "GEAR", "xx", "采购", "blue-ring", "large")]), (F.col("s_suppkey") % 8 + 1).cast("int"))
    own = s.select(F.col("s_nationkey").alias("owner"), words.alias("keyword"), F.col("s_acctbal").alias("updated"), F.lit("DIRECT").alias("kind")).groupBy("owner", "keyword", "kind").agg(F.max("updated").alias("updated"))
    parts = _rows(spark, sf_dir, "part").select("p_partkey", "p_name")
    return profile.capability_matches(parts, "p_partkey", F.col("p_name"), own, ["owner"], "keyword", "kind", "updated", 2).select("p_partkey", "owner", "keyword", "place")


def _by_key(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(key)


def private_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of customers as profiles: kinds by their keys, a strength by their balance, answers that may be missing."""
    names = list(scoring.CAPABILITIES)
    kind = lambda k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    key = F.col("c_custkey")
    strength = F.element_at(F.array(*map(F.lit, ["STRONG", "MEDIUM", "HISTORICAL", "WEAK", "OTHER"])), (key % 5 + 1).cast("int"))
    answer = lambda n: F.when(key % n == 0, True).when(key % n == 1, False)
    p = scoring.private_points(F.array(kind(key), kind(F.floor(key / 8))), strength, key % 6 == 0, answer(3), answer(2), answer(4))
    return _table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.*")


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, each with one thing or another wrong with it."""
    k = F.col("o_orderkey")
    url = F.when(k % 17 == 0, F.lit("http://www.ccgp.gov.cn/a")).when(k % 19 == 0, "https://ccgp.gov.cn.example/a").otherwise(F.concat(F.lit("https://www.ccgp.gov.cn/n/"), k))
    source = F.struct(F.when(k % 23 == 0, "BLOG").otherwise("CCGP_NOTICE").alias("source_type"), url.alias("url"), F.when(k % 29 == 0, "yesterday").otherwise("2001-07-15T08:00:00+08:00").alias("observed_at"))
    facts = {
        "project_name": ("string", F.when(k % 31 != 0, F.lit("p"))), "buyer_name": ("string", F.lit("b")), "notice_type": ("string", F.when(k % 37 == 0, " ").otherwise("t")),
        "published_at": ("string", F.date_format("o_orderdate", "yyyy-MM-dd")), "market_code": ("string", F.when(k % 41 == 0, "XX").when(k % 2 == 0, "tj").otherwise("BJ")),
        "market_name": ("string", F.when(k % 43 == 0, "河北")), "registration_deadline": ("string", F.when(k % 47 == 0, "2001-13-01T00:00:00Z").when(k % 3 == 0, "2001-07-20T10:00:00+08:00")),
        "registration_deadline_date": ("string", F.when(k % 5 == 0, "2001-07-20")), "budget_cny": ("bigint", F.when(k % 53 == 0, -1).otherwise(F.col("o_totalprice")).cast("long")),
    }
    paths = ["project_name", "buyer_name", "notice_type", "published_at", "registration_deadline", "registration_deadline_date"]
    piece = lambda p, page: F.struct(F.lit(f"facts.{p}").alias("field_path"), page.alias("source_url"), F.lit("x").alias("locator"))
    evidence = F.array(*[piece(p, url) for p in paths], F.when(k % 7 != 0, piece("budget_cny", F.when(k % 59 == 0, "https://other.example/").otherwise(url))).otherwise(piece("department", url)))
    fault = validate.record_fault(F.when(k % 61 == 0, "0.2").otherwise("0.1"), F.concat(F.lit("o"), k), source, facts, evidence)
    return _table(spark, sf_dir, "orders").select("o_orderkey", fault.alias("fault"))


def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    paths = F.when(k % 5 == 0, F.array(F.lit("facts.bid_deadline"))).otherwise(F.array().cast("array<string>"))
    changes = F.when(k % 3 == 0, F.create_map(F.when(k % 7 == 0, "facts.budget_cny").otherwise("facts.bid_deadline"), F.when(k % 11 == 0, "2024-01-01").otherwise("2024-01-01T09:00:00+08:00")))
    fault = validate.event_fault(F.lit("0.1"), k.cast("string"), F.when(F.col("event_type") == "click", "OTHER").when(F.col("event_type") == "view", "TERMINATION").otherwise("CORRECTION"),
        F.when(k % 13 != 0, F.lit("n")), F.when(k % 17 == 0, "1999-01-01").otherwise("2024-01-01"), F.when(k % 19 == 0, "https://x.example/").otherwise("https://www.ccgp.gov.cn/e"), ["www.ccgp.gov.cn"], paths, changes)
    return _table(spark, sf_dir, "events").select("event_id", fault.alias("fault"))


def snapshot_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with their components checked; every ninth and tenth has a wrong sum or a private point."""
    c = _scored(spark, sf_dir)
    have = {"INTERVENTION_STAGE": F.col("p_stage"), "DEADLINE_URGENCY": F.col("p_urgency"), "PROJECT_AMOUNT": F.col("p_amount"), "PUBLICATION_FRESHNESS": F.col("p_fresh"), "RELATIONSHIP": F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(0)}
    parts = F.array(*[F.struct(F.lit(code).alias("code"), have.get(code, F.lit(0)).cast("int").alias("points"), F.when(F.lit(code == "PROJECT_AMOUNT") & (F.col("o_orderkey") % 13 == 0), 11).otherwise(most).alias("max_points")) for code, most in cards.MAX_POINTS.items()])
    fault = cards.priority_fault(parts, F.col("score") + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0))
    whole = cards.card_fault(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("VERIFIED"), F.array(F.when(F.col("o_orderkey") % 8 == 0, "http://x").otherwise("https://x.example/a")), fault)
    return c.select("o_orderkey", whole.alias("fault"))


def decision_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = _scored(spark, sf_dir).withColumn("allowed", cards.allowed_actions(F.array(F.when(k % 3 == 0, "http://x").otherwise("https://x")), k % 2 == 0, F.col("win"), F.col("relative_day").isNotNull(), k % 5 == 0))
    pick = lambda n: F.element_at(F.array(*map(F.lit, ["VERIFY_REQUIREMENTS", "REVIEW_OFFICIAL_SOURCE", "CONTACT_PUBLIC_CONTACT", "PREPARE_REQUIRED_MATERIALS", "CHECK_LATE_WINDOW_OPTIONS"])), (F.floor(k / n) % 5 + 1).cast("int"))
    codes = F.when(k % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(1), pick(7)))
    return c.select("o_orderkey", F.array_join("allowed", ",").alias("allowed"), cards.decision_fault(codes, F.col("allowed")).alias("fault"))


def outcome_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orders by recognised reason: a code, or a label in a note."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "WON").when(F.col("o_orderstatus") == "O", "LOST").otherwise("NOT_FIT")
    reason = F.when(k % 3 == 0, "PRICE").when(k % 3 == 1, " TIMING ")
    note = F.concat(F.when(k % 5 < 2, "why: ").otherwise("said: "), F.when(k % 2 == 0, "price").otherwise("speed"))
    code = analytics.recognised_reason(F.col("state"), F.col("reason"), F.col("note"), {"WON": ["SPEED"], "LOST": ["PRICE", "TIMING"], "NOT_FIT": ["TIMING"]}, {"WON": "why:", "LOST": "why:"}, {"WON": {"speed": "SPEED"}, "LOST": {"price": "PRICE"}})
    rows = _table(spark, sf_dir, "orders").select("o_orderpriority", state.alias("state"), reason.alias("reason"), note.alias("note"))
    return analytics.reason_counts(rows, ["o_orderpriority"], "state", code, most=10_000_000)


def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.risks(_table(spark, sf_dir, "documents"), [F.col("source")], {"SHORT": F.col("n_chars") < 500, "LONG": F.col("n_chars") > 20_000, "FOREIGN": F.col("lang") != "en"})
    return analytics.risk_summary(found, "source", ["LONG"], ["SHORT", "LONG"])


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.region_groups(_table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    d = analytics.dashboard(o, {"open_orders": F.col("o_orderstatus") == "O"}, {"cents": F.col("cents")}, {"customers": F.col("o_custkey")})
    return d.withColumn("cents_avg", F.round("cents_avg", 2))


def market_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return analytics.sync_report(o, "c_mktsegment", {"finished": F.col("o_orderstatus") == "F", "pending": F.col("o_orderstatus") == "P"})


def staged_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events staged before their user's last purchase are cleared by it as by a full cycle."""
    e = _events(spark, sf_dir)
    cycles = e.where("event_type = 'purchase'").select("user_id", F.col("at_s").alias("done"))
    return ledger.after_full_cycle(e.where("event_type <> 'purchase'"), cycles, "user_id", "at_s", "done").select("event_id", "user_id")


def ledger_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of users scanned twice, verified in between: errors fail, the rest succeeds."""
    e = _events(spark, sf_dir)
    scan = lambda low, high: ranking.latest(e, ["user_id"], ["at_s", "event_id"], ["event_type"], F.col("at_s").between(low, high)).select("user_id", F.col("event_type").alias("fingerprint"))
    empty = spark.createDataFrame([], "user_id long, fingerprint string, first_seen long, last_seen long, last_verified long, verified_fingerprint string, status string, failures int, last_error string")
    one = ledger.observed(empty, scan(0, 1_704_500_000), "user_id", F.lit(1_704_500_000).cast("long"))
    checked = one.select("user_id", F.when(F.col("fingerprint") == "error", "TIMEOUT").alias("error"))
    two = ledger.settled(one, checked, "user_id", F.lit(1_704_600_000).cast("long"))
    return ledger.observed(two, scan(1_704_500_001, 1_705_000_000), "user_id", F.lit(1_705_000_000).cast("long"))


def profile_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's rows with one key the last capability and the first target."""
    e = _events(spark, sf_dir).select("user_id", F.upper("event_type").alias("key"), "at_s", "event_id")
    last = merge.last_wins(e, ["user_id", "key"], ["at_s", "event_id"]).select("user_id", "key", F.col("event_id").alias("capability"))
    first = merge.first_wins(e, ["user_id", "key"], ["at_s", "event_id"]).select("user_id", "key", F.col("event_id").alias("target"))
    return last.join(first, ["user_id", "key"])


def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a buckets, canonical addresses and canonical JSON hashes of pages."""
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", text.fnv1a(F.col("url"), 97).alias("slot"), text.canonical_https(F.col("url")).alias("https_url"), text.canonical_json_hash(url=F.col("url"), page=F.col("page_id")).alias("mark"))


def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" 天津市 "), F.col("c_name"))).when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, "  ")
    return c.select("c_custkey", text.region_code(label).alias("region"), text.market_of(label, {"TJ": ["天津"], "XX": ["Customer#00000000"]}).alias("market"))


QUERIES = {f.__name__: f for f in (
    card_scores, combined_pool, today_cards, followed_actions, due_reminders, pool_search, selected_candidates, capability_join, private_points, record_validation, event_validation,
    snapshot_validation, decision_grounding, outcome_reasons, risk_summary, region_groups, dashboard, market_report, staged_release, ledger_transitions, profile_normalised, anchor_lookup, region_codes,
)}

_EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 AS at_s FROM events)"
_DUE = f"coalesce(status NOT IN ('WON', 'LOST', 'NOT_FIT', 'ARCHIVED') AND remind_at <= {NOW}, false)"
_CAPS = "DIRECT_AUTHORIZED RENTAL_CAPABLE DIRECT DIRECT_UNCONFIRMED NEED_MANUFACTURER CAN_SOURCE_PARTNER PARTNER SERVICE_ONLY".split()

ORACLE_SQL = {
    "card_scores": f"""
        WITH {_CARDS} SELECT o_orderkey, mode, CASE mode WHEN 'ARCHIVE' THEN 'NOT_ELIGIBLE' ELSE 'AWAITING_MODEL' END AS status, served_mode, win, next_deadline,
               p_stage::INT AS p_stage, p_urgency::INT AS p_urgency, p_amount::INT AS p_amount, p_fresh::INT AS p_fresh, score, bucket, tier FROM scored""",
    "combined_pool": f"""
        WITH {_CARDS}, b AS (SELECT * FROM scored WHERE mode <> 'ARCHIVE' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, next_deadline NULLS LAST, published DESC, o_orderkey) = 1)
        SELECT row_number() OVER (ORDER BY score DESC, next_deadline NULLS LAST, published DESC, o_orderkey)::INT AS rank, o_custkey, o_orderkey, score FROM b QUALIFY rank <= 500""",
    "today_cards": f"""
        WITH {_FOLLOWUPS}, j AS (
            SELECT o.o_orderkey, coalesce(status, 'NEW') AS followup_status, remind_at,
                   (CASE WHEN coalesce(status <> 'NEW', false) OR remind_at IS NOT NULL THEN 0 WHEN o.o_orderkey % 7 = 0 THEN 2 WHEN o.o_orderkey % 7 = 1 THEN 1 ELSE 0 END)::INT AS tier
            FROM orders o LEFT JOIN fu USING (o_orderkey)
            WHERE coalesce(status NOT IN ('CONTACTED', 'NOT_FIT', 'BID_SUBMITTED', 'WON', 'LOST', 'ARCHIVED'), true) AND (remind_at IS NULL OR remind_at <= {NOW}))
        SELECT * FROM j WHERE tier < 2""",
    "followed_actions": f"""
        WITH {_FOLLOWUPS}, t AS (
            SELECT o_custkey, o_orderkey, status, remind_at, updated,
                   (CASE WHEN {_DUE} THEN 0 WHEN status NOT IN ('WON', 'LOST') AND remind_at IS NOT NULL THEN 1 WHEN status IN ('NEW', 'REVIEWING') THEN 2 WHEN status = 'MONITOR' THEN 3 ELSE 4 END)::INT AS tier
            FROM fu JOIN orders USING (o_orderkey))
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, CASE WHEN tier <= 1 THEN remind_at END NULLS LAST, updated DESC, o_orderkey)::INT AS place, tier,
               concat_ws(',', CASE WHEN {_DUE} THEN 'DUE' END, CASE WHEN status IN ('NEW', 'REVIEWING') THEN 'ACTIVE' END, CASE WHEN status = 'MONITOR' THEN 'MONITOR' END, CASE WHEN status = 'WON' THEN 'WON' END, CASE WHEN status IN ('WON', 'LOST') THEN 'CLOSED' END) AS tabs
        FROM t QUALIFY place <= 5""",
    "due_reminders": f"""
        WITH {_FOLLOWUPS} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY remind_at, o_orderkey)::INT AS place,
               'mrem_' || sha256(o_custkey || chr(10) || o_orderkey || chr(10) || remind_at) AS reminder_id
        FROM fu JOIN orders USING (o_orderkey) WHERE {_DUE} QUALIFY place <= 20""",
    "pool_search": f"""
        WITH {_CARDS}, f AS (
            SELECT *, mode = 'PRE_MARKET_SIGNAL' OR lifecycle = 'PROCUREMENT_INTENT' AS early FROM scored JOIN customer ON o_custkey = c_custkey
            WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name || ' ' || c_mktsegment), 'customer#00000001'))
        SELECT o_orderkey, 'OPEN' AS shown_in FROM f WHERE mode <> 'LATE_WINDOW' AND NOT early UNION ALL
        SELECT o_orderkey, 'PRE_MARKET_SIGNAL' FROM f WHERE early UNION ALL SELECT o_orderkey, 'LATE_WINDOW' FROM f WHERE mode = 'LATE_WINDOW'""",
    "selected_candidates": r"""
        WITH p AS (
            SELECT page_id, url, regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '([a-z]+)$', 1) AS market, lpad((page_id % 50)::VARCHAR, 3, '0') AS published,
                   (CASE WHEN contains(url, 'blog') THEN 3 WHEN contains(url, '/en/') AND starts_with(url, 'https') THEN 2 ELSE 1 END)::INT AS priority FROM pages),
        s AS (SELECT *, url NOT IN (SELECT url FROM p WHERE page_id % 2 = 0) AS unseen FROM p)
        SELECT market, url, page_id, priority, unseen, row_number() OVER (PARTITION BY market ORDER BY unseen DESC, priority DESC, published DESC, url DESC)::INT AS place FROM s QUALIFY place <= 40""",
    "capability_join": """
        WITH k(i, keyword, term) AS (VALUES (0, 'Bolt', 'bolt'), (1, 'red widget', 'redwidget'), (3, 'GEAR', 'gear'), (6, 'blue-ring', 'bluering'), (7, 'large', 'large')),
        o AS (SELECT s_nationkey AS owner, keyword, term, max(s_acctbal) AS updated FROM supplier JOIN k ON s_suppkey % 8 = i GROUP BY ALL)
        SELECT p_partkey, owner, keyword, row_number() OVER (PARTITION BY p_partkey, owner ORDER BY updated DESC, keyword)::INT AS place
        FROM part JOIN o ON contains(replace(lower(p_name), ' ', ''), term) QUALIFY place <= 2""",
    "private_points": f"""
        WITH n AS (SELECT {_CAPS} AS names),
        c AS (SELECT c_custkey AS k, names[1 + c_custkey % 8] AS a, names[1 + c_custkey // 8 % 8] AS b,
                     CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS find, CASE c_custkey % 2 WHEN 0 THEN true WHEN 1 THEN false END AS partner, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS lease FROM customer, n),
        w AS (SELECT * FROM (VALUES ('DIRECT_AUTHORIZED', 25), ('RENTAL_CAPABLE', 22), ('DIRECT', 18), ('DIRECT_UNCONFIRMED', 18), ('NEED_MANUFACTURER', 14), ('CAN_SOURCE_PARTNER', 14), ('PARTNER', 12), ('SERVICE_ONLY', 8)) t(kind, p))
        SELECT k AS c_custkey, greatest((SELECT p FROM w WHERE kind = a), (SELECT p FROM w WHERE kind = b))::INT AS capability, [10, 7, 4, 2, 0][1 + k % 5]::INT AS relationship,
               greatest(CASE WHEN coalesce(lease, false) AND (k % 6 = 0 OR 'RENTAL_CAPABLE' IN (a, b)) THEN 5 ELSE 0 END,
                        CASE WHEN coalesce(find, false) AND ('NEED_MANUFACTURER' IN (a, b) OR 'CAN_SOURCE_PARTNER' IN (a, b)) THEN 3 ELSE 0 END,
                        CASE WHEN coalesce(partner, false) AND ('PARTNER' IN (a, b) OR 'CAN_SOURCE_PARTNER' IN (a, b)) THEN 3 ELSE 0 END,
                        CASE WHEN coalesce(find, false) AND coalesce(partner, false) AND 'CAN_SOURCE_PARTNER' IN (a, b) THEN 5 ELSE 0 END)::INT AS flexibility FROM c""",
    "record_validation": """
        SELECT o_orderkey, CASE WHEN k % 61 = 0 THEN 'SCHEMA_VERSION_UNSUPPORTED' WHEN k % 23 = 0 THEN 'UNSUPPORTED_SOURCE_TYPE' WHEN k % 17 = 0 THEN 'INVALID_SOURCE_URL' WHEN k % 19 = 0 THEN 'CCGP_HOST_MISMATCH'
               WHEN k % 29 = 0 THEN 'INVALID_DATE' WHEN k % 41 = 0 THEN 'MARKET_CODE_INVALID' WHEN k % 43 = 0 THEN 'MARKET_NAME_MISMATCH' WHEN k % 31 = 0 THEN 'REQUIRED_FACT_MISSING:facts.project_name'
               WHEN k % 37 = 0 THEN 'REQUIRED_FACT_MISSING:facts.notice_type' WHEN k % 47 = 0 THEN 'INVALID_DATE:facts.registration_deadline' WHEN k % 5 = 0 AND k % 3 = 0 THEN 'REGISTRATION_DEADLINE_PRECISION_CONFLICT'
               WHEN k % 53 = 0 THEN 'INVALID_BUDGET_CNY' WHEN k % 7 <> 0 AND k % 59 = 0 THEN 'EVIDENCE_SOURCE_MISMATCH' WHEN k % 7 = 0 THEN 'UNSUPPORTED_CRITICAL_FACT:facts.budget_cny' END AS fault
        FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "event_validation": """
        SELECT event_id, CASE WHEN event_type = 'click' THEN 'EVENT_TYPE_INVALID' WHEN event_id % 13 = 0 THEN 'EVENT_PROJECT_NUMBER_REQUIRED' WHEN event_id % 17 = 0 THEN 'EVENT_PUBLISHED_DATE_INVALID'
               WHEN event_id % 19 = 0 THEN 'EVENT_SOURCE_HOST_REJECTED' WHEN event_id % 21 = 0 THEN 'EVENT_FACT_OVERRIDE_PATH_INVALID' WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'EVENT_FACT_OVERRIDE_WITHOUT_CHANGE'
               WHEN event_id % 33 = 0 THEN 'EVENT_FACT_OVERRIDE_VALUE_INVALID' END AS fault FROM events""",
    "snapshot_validation": f"""
        WITH {_CARDS} SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'CARD_INVALID' WHEN o_orderstatus = 'P' THEN 'CARD_NOT_VERIFIED' WHEN o_orderkey % 8 = 0 THEN 'EVIDENCE_INVALID'
               WHEN o_orderkey % 13 = 0 THEN 'PRIORITY_COMPONENT_INVALID' WHEN o_orderkey % 10 = 0 THEN 'PRIVATE_SCORE_PRESENT' WHEN o_orderkey % 9 = 0 THEN 'PRIORITY_SCORE_INVALID' END AS fault FROM scored""",
    "decision_grounding": f"""
        WITH {_CARDS}, a AS (
            SELECT o_orderkey AS k, list_filter(['VERIFY_REQUIREMENTS', CASE WHEN k % 3 <> 0 THEN 'REVIEW_OFFICIAL_SOURCE' END, CASE WHEN k % 2 = 0 THEN 'CONTACT_PUBLIC_CONTACT' END,
                   CASE WHEN win IN ('OPEN', 'RELATIVE_WINDOW') THEN 'PREPARE_REQUIRED_MATERIALS' END, CASE WHEN win = 'RELATIVE_WINDOW' AND rel_day IS NOT NULL THEN 'CONFIRM_RELATIVE_WINDOW' END,
                   CASE WHEN win = 'LATE_WINDOW' THEN 'CHECK_LATE_WINDOW_OPTIONS' END, CASE WHEN k % 5 = 0 THEN 'MATCH_CONFIRMED_RESOURCES' END], lambda x: x IS NOT NULL) AS al,
                   ['VERIFY_REQUIREMENTS', 'REVIEW_OFFICIAL_SOURCE', 'CONTACT_PUBLIC_CONTACT', 'PREPARE_REQUIRED_MATERIALS', 'CHECK_LATE_WINDOW_OPTIONS'] AS ns, ns[1 + k % 5] AS c1, ns[1 + k // 7 % 5] AS c2 FROM scored)
        SELECT k AS o_orderkey, array_to_string(al, ',') AS allowed, CASE WHEN k % 29 = 0 THEN 'AI_DECISION_INVALID' WHEN c1 = c2 THEN 'AI_DECISION_DUPLICATE_ACTION'
               WHEN NOT list_contains(al, c1) OR NOT list_contains(al, c2) THEN 'AI_DECISION_ACTION_NOT_GROUNDED' END AS fault FROM a""",
    "outcome_reasons": """
        WITH r AS (
            SELECT o_orderpriority, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'WON' WHEN 'O' THEN 'LOST' ELSE 'NOT_FIT' END AS state FROM orders),
        c AS (
            SELECT o_orderpriority, state, CASE state WHEN 'WON' THEN CASE WHEN k % 5 < 2 AND k % 2 = 1 THEN 'SPEED' END
                   WHEN 'LOST' THEN CASE WHEN k % 3 = 0 THEN 'PRICE' WHEN k % 3 = 1 THEN 'TIMING' WHEN k % 5 < 2 AND k % 2 = 0 THEN 'PRICE' END ELSE CASE WHEN k % 3 = 1 THEN 'TIMING' END END AS code FROM r),
        n AS (SELECT o_orderpriority, state, code, count(*) AS n_rows FROM c GROUP BY ALL)
        SELECT *, CASE WHEN code IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderpriority, state, code IS NULL ORDER BY n_rows DESC, code)::INT END AS place FROM n""",
    "risk_summary": """
        WITH f AS (SELECT source, 'SHORT' AS risk FROM documents WHERE n_chars < 500 UNION ALL SELECT source, 'LONG' FROM documents WHERE n_chars > 20000 UNION ALL SELECT source, 'FOREIGN' FROM documents WHERE lang <> 'en')
        SELECT count(*) AS n_risks, count(DISTINCT source) AS affected, count(DISTINCT source) FILTER (risk = 'LONG') AS high, count(DISTINCT source) FILTER (risk IN ('SHORT', 'LONG')) AS continuation FROM f""",
    "region_groups": "SELECT s_nationkey, count(*) AS n_rows, sha256(string_agg(s_suppkey || ':' || s_name, chr(10) ORDER BY s_suppkey)) AS group_hash FROM supplier GROUP BY s_nationkey",
    "dashboard": "SELECT count(*) AS n_rows, count_if(o_orderstatus = 'O')::BIGINT AS open_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, round(avg(round(o_totalprice * 100)::BIGINT), 2) AS cents_avg, count(DISTINCT o_custkey) AS customers FROM orders",
    "market_report": "SELECT c_mktsegment, count(*) AS n_rows, count_if(o_orderstatus = 'F')::BIGINT AS finished, count_if(o_orderstatus = 'P')::BIGINT AS pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "staged_release": f"WITH {_EV}, d AS (SELECT user_id, max(at_s) AS done FROM ev WHERE event_type = 'purchase' GROUP BY user_id) SELECT event_id, user_id FROM ev LEFT JOIN d USING (user_id) WHERE event_type <> 'purchase' AND (done IS NULL OR at_s > done)",
    "ledger_transitions": f"""
        WITH {_EV}, a AS (SELECT user_id, arg_max(event_type, (at_s, event_id)) AS f FROM ev WHERE at_s <= 1704500000 GROUP BY user_id),
        b AS (SELECT user_id, arg_max(event_type, (at_s, event_id)) AS f FROM ev WHERE at_s BETWEEN 1704500001 AND 1705000000 GROUP BY user_id),
        j AS (SELECT user_id, a.f AS was, b.f AS is_, coalesce(b.f <> a.f, a.f IS NULL) AS fresh FROM a FULL JOIN b USING (user_id))
        SELECT user_id, coalesce(is_, was) AS fingerprint, CASE WHEN was IS NULL THEN 1705000000 ELSE 1704500000 END::BIGINT AS first_seen, CASE WHEN is_ IS NULL THEN 1704500000 ELSE 1705000000 END::BIGINT AS last_seen,
               CASE WHEN was <> 'error' THEN 1704600000 END::BIGINT AS last_verified, CASE WHEN was <> 'error' THEN was END AS verified_fingerprint,
               CASE WHEN fresh THEN 'UNVERIFIED' WHEN was = 'error' THEN 'FAILED' ELSE 'VERIFIED' END AS status, (CASE WHEN NOT fresh AND was = 'error' THEN 1 ELSE 0 END)::INT AS failures,
               CASE WHEN NOT fresh AND was = 'error' THEN 'TIMEOUT' END AS last_error FROM j""",
    "profile_normalised": f"WITH {_EV} SELECT user_id, upper(event_type) AS key, arg_max(event_id, (at_s, event_id)) AS capability, arg_min(event_id, (at_s, event_id)) AS target FROM ev GROUP BY ALL",
    "anchor_lookup": r"""
        SELECT page_id, (list_reduce(list_prepend(2166136261::UHUGEINT, list_transform(range(1, length(url) + 1), lambda i: unicode(substr(url, i, 1))::UHUGEINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 97)::INT AS slot,
               CASE WHEN regexp_matches(url, '(?i)^https://') THEN 'https://' || lower(regexp_extract(url, '(?i)^https://([^/?#]*)', 1)) || regexp_extract(url, '(?i)^https://[^/?#]*([^#]*)', 1) END AS https_url,
               sha256('{"page":' || page_id || ',"url":"' || url || '"}') AS mark FROM pages""",
    "region_codes": """
        WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '天津市 ' || c_name WHEN 1 THEN c_name END AS label FROM customer)
        SELECT c_custkey, CASE WHEN label IS NULL THEN 'CN-UNKNOWN' WHEN contains(label, '天津') THEN 'CN-TJ' ELSE 'CN-REGION-' || left(sha256('"' || label || '"'), 10) END AS region,
               CASE WHEN starts_with(label, '天津') THEN 'TJ' WHEN starts_with(label, 'Customer#00000000') THEN 'XX' END AS market FROM l""",
}
