"""The operators applied to whole driver tables. Each query has SQL in oracle.py where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import html, text, times
from sievegrid.operators import analytics, events, ledger, matching, merge, ranking, scoring, validate
from sievegrid.streaming import scans

AS_OF = "2001-07-15 00:00:00"
#: The pool's own cap: a top-k report.
POOL = 500
DAYS = {"1": 7, "2": 14, "3": 30, "4": 60, "5": 90}
AMOUNTS = [(400_000, 10), (250_000, 9), (100_000, 7), (50_000, 4)]
# Fixed values of the scope rules on the invented prose.
SCOPE = {"hard": ["password", "ssn"], "strong": ["license"], "generic": ["%%%", "***"], "adjacent": ["tion of"], "contextual": ["the the"], "context": ["version", "from"], "acronyms": ["GNU", "MIT"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Orders as opportunities: price is the amount, the priority sets the days to the deadline."""
    o = _table(spark, sf_dir, "orders")
    now = times.epoch_seconds(F.lit(as_of).cast("timestamp_ntz"))
    days = F.coalesce(*[F.when(F.substring("o_orderpriority", 1, 1) == k, F.lit(d)) for k, d in DAYS.items()])
    published = times.epoch_seconds(F.col("o_orderdate"))
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", published.alias("published"), (published + days * 86_400).alias("deadline"), now.alias("now"))
    open_ = F.col("deadline") > F.col("now")
    o = o.where(F.col("published") <= F.col("now"))
    points = {
        "window": F.when(open_, 25).otherwise(0),
        "urgency": F.when(open_, scoring.deadline_points((F.col("deadline") - F.col("now")) / 3600)).otherwise(0),
        "amount": scoring.amount_points(F.col("o_totalprice"), AMOUNTS),
        "fresh": scoring.freshness_points(F.floor((F.col("now") - F.col("published")) / 86_400)),
    }
    scored = o.withColumn("is_open", open_)
    for name, p in points.items():
        scored = scored.withColumn(name, p.cast("int"))
    return scored.withColumn("score", F.expr("`window` + urgency + amount + fresh"))


def _pool_order():
    return [F.col("score").desc(), F.col("deadline").asc_nulls_last(), F.col("published").desc(), F.col("o_orderkey").asc()]


def ranked_pool_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _orders(spark, sf_dir).where("is_open").select("o_orderkey", "score", "deadline", "published")
    return ranking.top(pool, _pool_order(), POOL)


def market_scoped_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    pool = _orders(spark, sf_dir).join(region, F.col("o_custkey") == F.col("c_custkey"))
    ranked = ranking.ranked_within(pool, ["n_regionkey"], _pool_order(), 50)
    return ranked.select("n_regionkey", "o_orderkey", "score", "rank")


def personalised_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments are capabilities, their balances relationships."""
    c = _table(spark, sf_dir, "customer")
    strength = F.when(F.col("c_acctbal") > 7500, "STRONG").when(F.col("c_acctbal") > 5000, "MEDIUM").when(F.col("c_acctbal") > 2500, "HISTORICAL").when(F.col("c_acctbal") > 0, "WEAK")
    known = c.select("c_custkey", (scoring.relationship_points(strength) + F.when(F.col("c_mktsegment") == "BUILDING", 25).otherwise(0)).cast("int").alias("private"))
    pool = _orders(spark, sf_dir).join(known, F.col("o_custkey") == F.col("c_custkey"))
    pool = pool.withColumn("total", scoring.personalised(F.col("score"), F.lit(0), F.col("private")))
    return ranking.top(pool.select("o_orderkey", "total", "score", "private"), [F.col("total").desc(), F.col("score").desc(), F.col("o_orderkey")], POOL)


def runtime_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders two weeks later: three components replaced, the totals of both days."""
    now = _orders(spark, sf_dir)
    later = _orders(spark, sf_dir, "2001-07-29 00:00:00").select("o_orderkey", F.col("window").alias("w2"), F.col("urgency").alias("u2"), F.col("fresh").alias("f2"))
    both = now.join(later, "o_orderkey")
    parts = F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).alias("points")) for n in ("window", "urgency", "amount", "fresh")])
    again = scoring.rescored(parts, {"window": F.col("w2"), "urgency": F.col("u2"), "fresh": F.col("f2")}, {"window": 25, "urgency": 10, "fresh": 7})
    return both.select("o_orderkey", "score", scoring.total(again).cast("int").alias("score_later"))


def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", times.epoch_seconds(F.col("ts")).alias("at_s"), "event_id", "value")
    return merge.last_wins(e, ["user_id", "event_type"], ["at_s", "event_id"])


def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256"), "doc_id", "source")
    return merge.first_wins(d, ["text_sha256"], ["doc_id"])


def dual_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a supplier: a line takes the slot of its order's part, or of its part with the supplier."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.format_string("%012d-%04d-%08d-%06d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.concat_ws("-", "l_suppkey", "l_orderkey").alias("id"), F.col("l_partkey").alias("number"))
    return merge.merge_by_two_keys(rows, "l_suppkey", "seq", "id", "number")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", times.epoch_seconds(F.col("ts")).alias("at_s"))


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what happens to sources (groups of users): sightings of users, verifications, ends of scans, full cycles."""
    e = _table(spark, sf_dir, "events").where("user_id is not null")
    n = F.pmod(F.xxhash64("event_id"), F.lit(100))
    kind = F.when(n < 45, "SEEN").when(n < 65, "VERIFIED").when(n < 70, "FAILED").when(n < 99, "SCAN_END").otherwise("FULL_CYCLE")
    at = times.epoch_seconds(F.col("ts"))
    return e.select(
        F.concat(F.lit("s"), F.col("user_id") % 97).alias("source"), F.col("event_id").cast("long").alias("seq"), at.alias("at_s"), kind.alias("kind"), F.col("user_id").cast("string").alias("url"),
        F.col("event_type").alias("mark"), F.floor(at / 900).cast("string").alias("bucket"),
    )


def source_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scans of all sources lead to."""
    return scans.outcomes(scan_events(spark, sf_dir))


def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.versions(_events(spark, sf_dir), "user_id", ["at_s", "event_id"], F.col("event_type")).select("user_id", "version", "event_type", "at_s", "event_id")


def scd2_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.versions(_events(spark, sf_dir), "user_id", ["at_s", "event_id"], F.col("event_type"), strict=True).select("user_id", "version", "event_type", "at_s", "event_id")


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = _events(spark, sf_dir).withColumn("level", F.floor("value").cast("long"))
    by = Window.partitionBy("user_id").orderBy("at_s", "event_id")
    before = {f: F.lag(f).over(by) for f in ("event_type", "level", "props")}
    changed = merge.changed_fields(before, {f: F.col(f) for f in before})
    return e.select("event_id", F.array_join(changed, ",").alias("changed"))


def event_fold_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases override a value per hour of day, errors leave it open, dear signups end a record."""
    e = _events(spark, sf_dir)
    path = F.when(F.col("event_type").isin("purchase", "error"), F.concat(F.lit("h"), F.floor(F.pmod("at_s", F.lit(86_400)) / 3600)))
    state = events.fold(
        e, ["user_id"], ["at_s", "event_id"], F.lit(1_705_708_800), "at_s", path,
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("string")), F.col("event_type") == "error", F.lit(False),
        (F.col("event_type") == "signup") & (F.col("value") > 100),
    )
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("overrides")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return state.select("user_id", shown.alias("overrides"), "suppressed", "terminated", "n_events")


def state_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "at_s", "event_id", "event_type")
    return analytics.ordered_json(e, "user_id", ["at_s", "event_id"], ["event_id", "event_type"], 20)


def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(_events(spark, sf_dir), ["user_id"], ["at_s", "event_id"], ["event_id", "at_s", "value"], F.col("event_type") == "error")


def page_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.page(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 100)


def set_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two years, marked by the orders they placed."""
    o = _table(spark, sf_dir, "orders")
    of = lambda y: o.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return merge.set_delta(of(1996), of(1997), ["o_custkey"], "n")


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outcome_summary(_table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus"), "F", "O", "P")


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reason_histogram(_table(spark, sf_dir, "orders"), F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])


def feedback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.feedback_rate(_table(spark, sf_dir, "labels"), F.col("quality") == 1)


def coverage_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.risks(_table(spark, sf_dir, "documents"), [F.col("source")], {"SHORT": F.col("n_chars") < 500, "LONG": F.col("n_chars") > 20_000, "FOREIGN": F.col("lang") != "en"})
    return found.groupBy("source", "risk").agg(F.count("*").alias("n_rows"))


def trailing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trailing_run(_events(spark, sf_dir), "user_id", ["at_s", "event_id"], F.col("event_type") != "click")


def finding_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.finding_ledger(_events(spark, sf_dir), ["user_id", "event_type"], "user_id", F.col("at_s"))


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    names = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey").agg(text.set_fingerprint(F.collect_list("n_name")).alias("region_mark"))
    one = c.select("c_custkey", "c_nationkey", text.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("mark"), text.stable_id("cust", F.col("c_name")).alias("stable"))
    home = one.join(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return home.join(names, "n_regionkey").select("c_custkey", "mark", "stable", "region_mark")


def change_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.observed_changes(_events(spark, sf_dir), ["user_id"], ["at_s", "event_id"], F.col("event_type"), F.col("at_s"), 43_200)
    return e.select("event_id", "reason")


def scan_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    e = e.withColumn("b", times.scan_bucket(F.col("ts"), 180)).drop("ts")
    return ledger.once_per_bucket(e, "event_type", F.col("b"), ["event_id"]).select("event_type", "bucket", "event_id")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.rate_limited(_events(spark, sf_dir), "event_type", F.col("at_s"), ["at_s", "event_id"], 3600, 3)
    return e.select("event_id", "window_start", "hits", "limited")


def first_hit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_hit_windows(_events(spark, sf_dir), "user_id", "at_s", 86_400, 3)


def verification_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("value").isNotNull())
    picked = ranking.budgeted(e, "event_type", F.col("at_s") < 1_704_412_800, [F.col("value").desc(), F.col("at_s").desc(), F.col("event_id")], 60, ["event_id"])
    return picked.select("event_id", "event_type", "selected")


def due_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _events(spark, sf_dir).groupBy("event_type").agg(F.max("at_s").alias("completed"), F.count("*").alias("n"))
    every = every.withColumn("interval_s", ledger.next_interval(F.lit(3600), F.col("n") % 2 == 0, F.lit(False)))
    return ranking.due_source(every, F.lit(1_706_745_600), "completed", "interval_s", "event_type").select("event_type", "completed", "overdue")


def tick_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick that follows each event on its day's grid in Shanghai, missed ones skipped, and the events that wait for it."""
    minute = (F.floor((F.col("at_s") + 8 * 3600) / 60) % 1440).cast("int")
    day = F.date_format(F.timestamp_seconds(F.col("at_s") + 8 * 3600), "yyyy-MM-dd")
    e = _events(spark, sf_dir).select(day.alias("day"), ledger.next_tick(minute).alias("minute_of_day"))
    waiting = e.groupBy("day", "minute_of_day").agg(F.count("*").alias("n_events"))
    return waiting.withColumn("tick", ((F.col("minute_of_day") - 690) / 15).cast("int"))


def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders of the same customer with the same priority, the first three."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", times.epoch_seconds(F.col("o_orderdate")).alias("at_s"), "o_orderpriority", "o_orderstatus")
    return matching.successors(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), "o_custkey", "at_s", "o_orderpriority", "o_orderkey")


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("blue", "colour"), ("red", "colour"), ("steel", "material"), ("1", "digit"), ("part", "noun"), ("", "none")], "keyword string, kind string")
    return matching.keyword_matches(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", words, "keyword").select("p_partkey", "keyword", "kind")


def scope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations by containment of names, with the best balance of those that match."""
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.max("s_acctbal").alias("balance"))
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("office "), "n_name").alias("name"))
    return matching.best_scope(c, "c_custkey", "name", s, "n_name", "balance")


def scope_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", matching.scope(F.col("text"), F.col("source"), SCOPE).alias("scope"), matching.primary(F.col("text"), F.col("lang"), F.col("source"), ["Released", "src1"]).alias("is_primary"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", text.official_url(F.col("url")).alias("canonical"), text.host(F.col("url")).alias("host"))


def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.regex_anchors(F.col("html"))).alias("place", "a"))
    return p.select("page_id", "place", "a.url", "a.title")


def anchor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.anchors("html", "url")).alias("place", "a"))
    return p.select("page_id", "place", "a.url", "a.title")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.visible_text("html").alias("text"))


def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    checks = [("TEXT_MISSING", validate.filled(F.col("text"), "string")), ("LANG", F.col("lang").isin("en", "de", "fr")), ("SIZE", F.col("n_chars") == F.length("text")), ("SHORT", F.col("n_chars") >= 100)]
    return d.select("doc_id", validate.error_code(checks).alias("error_code"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_keys(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


def grounding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as outputs: toxic ones were never asked for, every fifth has a wrong format; English ones are the gold set."""
    outputs = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "UNGROUNDED").when(F.col("doc_id") % 5 == 0, "INVALID").alias("rejected"))
    gold = _table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return analytics.discovery_metrics(outputs, gold, "doc_id", "rejected")


def grounded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model outputs; a user's own pages are those that a customer key names."""
    e = _events(spark, sf_dir).select("event_id", F.lit(1).alias("scan"), F.col("user_id").cast("string").alias("url"), (F.col("value") / 100).alias("confidence"), F.col("event_type").alias("kind"), "props")
    allowed = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit(1).alias("scan"), F.col("c_custkey").cast("string").alias("url"))
    return validate.grounded(e, allowed, "scan", "url", "confidence", "props", ["click", "purchase", "view"], "kind").select("event_id", "rejected")


def export_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["customer", "events", "labels", "nation", "orders", "part", "region", "supplier"]
    parts = [_table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("part"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).where((F.col("c_acctbal") > 0) & (F.col("o_orderstatus") != "P"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("amount"))


def idempotent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("mutation", F.floor(F.col("at_s") / 7200)).withColumn("remind", F.when(F.col("event_type") == "view", F.col("at_s")))
    return merge.idempotent_states(e, "user_id", "mutation", ["at_s", "event_id"], "event_type", "remind", ["purchase"])


def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in the last two days but not in the last hour's scan."""
    now = 1_706_000_000
    scanned = _events(spark, sf_dir).where(F.col("at_s").between(now - 3600, now)).select("user_id")
    before = _events(spark, sf_dir).where(F.col("at_s") <= now).groupBy("user_id").agg(F.max("at_s").alias("seen"))
    return ledger.carried_over(ledger.pruned(before, F.lit(now), "seen"), scanned, "user_id", F.lit(now), "seen")


def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    old = ranking.latest(e, ["user_id"], ["at_s", "event_id"], ["event_type"], F.col("at_s") < 1_705_000_000).select("user_id", F.col("event_type").alias("fact_hash"), F.lit(1).alias("version"), F.lit(1_705_000_000).cast("long").alias("last_seen"))
    new = ranking.latest(e, ["user_id"], ["at_s", "event_id"], ["event_type", "at_s"]).select("user_id", F.col("event_type").alias("fact_hash"), F.col("at_s").alias("seen"))
    return merge.upsert_versions(old, new, "user_id")


QUERIES = {f.__name__: f for f in (
    ranked_pool_top, market_scoped_rank, personalised_rank, runtime_rescore, keyed_last_wins, first_wins_dedupe, dual_key_merge, source_scans, scd2_versions,
    scd2_strict, version_diff, event_fold_as_of, state_json_agg, latest_per_group, page_lookahead, set_delta, outcome_summary, reason_histogram,
    feedback_rate, coverage_risk, trailing_runs, finding_ledger, content_fingerprint, change_reasons, scan_bucket, rate_limit, first_hit_windows,
    verification_budget, due_source, tick_grid, lineage_pairs, containment_join, scope_match, scope_classifier, url_canonical, anchor_extract,
    anchor_parse, html_text, validation_codes, repeated_keys, grounding_metrics, grounded_outputs, export_bundle, session_join, idempotent_states,
    carry_over, upsert_versions,
)}
