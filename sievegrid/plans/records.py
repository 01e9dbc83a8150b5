"""Queries of payloads, crawls, as-of lookups and lists over whole driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import html, payload, text
from sievegrid.operators import accounts, asof, crawl, ledger, matching, merge, profile, ranking, scoring
from sievegrid.plans.tables import _events, _table

MOST_PAGES, MOST_ANCHORS = 4, 22


def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested payloads: canonical hash, a value by its path, keys changed since the user's last event, and forbidden keys."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    said = F.concat(F.lit('{ "type": "'), "event_type", F.lit('", "facts": {"z": '), "props", F.lit(', "list": [1, {"y": null, "session_id": "'), "event_type", F.lit('"}]}, "n": '), F.floor("value").cast("string"), F.lit("}"))
    by = Window.partitionBy("user_id").orderBy("at_s", "event_id")
    # Each payload is parsed once, after the shuffle: few files may hold many events.
    rows = e.repartition("user_id").select("event_id", "user_id", "at_s", F.try_parse_json(said).alias("v"))
    rows = rows.select("*", F.to_json("v").alias("p"), payload.fields_of(F.col("v")).alias("fields")).withColumn("before", F.lag("fields").over(by))
    return rows.select(
        "event_id", F.sha2("p", 256).alias("mark"), F.to_json(payload.value_of(F.col("v"), "facts", "z")).alias("z"), F.array_join(payload.changed_fields(F.col("before"), F.col("fields")), ",").alias("changed"),
        F.array_join(payload.forbidden_of(F.col("p"), ["user_id"], ["session"]), ",").alias("forbidden"), F.sha2(F.to_json(payload.bounded(F.col("v"), 2, 30, 3)), 256).alias("shown"),
    )


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name a next page by their number: every fifth starts a crawl, every eleventh is not stored."""
    p = _table(spark, sf_dir, "pages").where("page_id is not null")
    k = F.col("page_id")
    address = lambda n: F.concat(F.lit("https://h.example/p/"), n.cast("string"))
    following = F.when(k % 7 != 0, k + k % 3 * 2 + 1)
    body = F.concat(F.coalesce("html", F.lit("")), F.coalesce(F.concat(F.lit('<link rel="next" href="/p/'), following, F.lit('">')), F.lit("")))
    stored = p.where(k % 11 != 4).select(address(k).alias("url"), body.alias("h")).select("url", html.next_page(F.col("h"), F.col("url"), ["h.example"]).alias("next_url"), html.regex_anchors(F.col("h")).alias("anchors"))
    starts = p.where(k % 5 == 0).select(k.alias("source"), address(k).alias("url"))
    found = crawl.coverage(starts, stored, "source", "url", MOST_PAGES, MOST_ANCHORS)
    return found.select("source", F.array_join(F.transform("pages", lambda u: F.regexp_extract(u, "([0-9]+)$", 1)), ",").alias("pages"), "next_found", "limited", "partial", F.regexp_extract("resume", "([0-9]+)$", 1).alias("resume"), "n_anchors")


def as_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last view or click at its time."""
    e = _events(spark, sf_dir)
    asked = e.where("event_type = 'purchase'").select("user_id", "at_s", F.col("event_id").alias("purchase"))
    states = e.where("event_type in ('view', 'click')").select("user_id", "at_s", "event_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_id"))
    return asof.as_of(asked, states, ["user_id"], "at_s", ["event_id"], ["last_type", "last_id"]).select("purchase", "last_type", "last_id")


def benchmark_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the beginning of a benchmark item, whatever the length of either."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring("text", 1, 40)).alias("head")).where(F.length("head") >= 20)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("said"))
    return profile.containing(docs, "said", items, "head").select("doc_id", "item_id")


def institution_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards of institutions and departments against a list of nations' offices, some for one department only."""
    n = _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    items = n.select(F.lit("o").alias("owner"), F.col("n_name").alias("item"), F.when(k % 3 == 1, "BUILDING").when(k % 3 == 2, "mach inery").alias("part"), k.alias("strength"))
    cards = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == k).select("c_custkey", F.concat(F.lit("Office, "), F.lower("n_name")).alias("name"), "c_mktsegment")
    return profile.institution_matches(cards, "c_custkey", F.col("name"), F.col("c_mktsegment"), items, ["owner"], "item", "part", ["strength"]).select("c_custkey", "owner", "strength")


def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    points = scoring.specificity_points(F.col("p_size") > 25, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 7 == 0)
    return p.select("p_partkey", points.alias("points"))


def scoped_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of orders in scope, ranked anew, with the first five as cards."""
    return matching.scoped(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderstatus") == "F", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 500, 5).select("o_orderkey", "rank", "is_card")


def followed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as followed entries of owners: the latest note of each, those that are active, the last updated first."""
    e = _events(spark, sf_dir).where("user_id is not null").withColumn("owner", F.col("user_id") % 50)
    return ranking.followed(e, "owner", "user_id", ["at_s", "event_id"], "props", F.col("event_type") != "error").select("owner", "user_id", "note", F.col("at_s"), "place")


def url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as candidates; every third page's is known, with its number."""
    p = _table(spark, sf_dir, "pages")
    known = p.where("page_id % 3 = 0").select(F.col("page_id").alias("known"), F.array("url").alias("urls"))
    return matching.known_status(p.select("page_id", "url"), "url", known, "known", "urls").select("page_id", "known", "status")


def account_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts: their orders as follow-ups, the events of users of that number as notes, and their nation's offices as targets."""
    c = _table(spark, sf_dir, "customer")
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "props", "at_s")
    n = c.join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.lit("x").alias("x"))
    parts = {
        "followups": accounts.Part(o, "o_custkey", [], ["o_orderkey", "o_orderstatus", "day"]), "followup_events": accounts.Part(e, "user_id", [], ["event_id", "event_type", "props"]),
        "target_hospitals": accounts.Part(n, "c_custkey", [], ["n_name"]),
    }
    return accounts.export_lines(c, "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], parts, {"followups": "day", "followup_events": "at_s", "target_hospitals": "x"})


def profile_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their three newest orders and the two last events of the user of that number."""
    o = _table(spark, sf_dir, "orders")
    e = _events(spark, sf_dir)
    parts = {"orders": (accounts.Part(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], ["o_orderkey"]), 3), "events": (accounts.Part(e, "user_id", [F.col("at_s").desc(), F.col("event_id").desc()], ["event_id", "event_type"]), 2)}
    got = accounts.profiles(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", parts)
    return got.select("c_custkey", F.array_join(F.transform("orders", lambda i: i["o_orderkey"].cast("string")), ",").alias("orders"), F.array_join(F.transform("events", lambda i: F.concat_ws(":", i["event_id"], i["event_type"])), ",").alias("events"))


def followup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards: a follow-up by each user's last event, with the last four of its history."""
    e = _events(spark, sf_dir).where("user_id is not null")
    f = ranking.latest(e, ["user_id"], ["at_s", "event_id"], ["event_type"]).select(F.col("user_id").alias("c_custkey"), (F.col("user_id") + 1_000_000).alias("followup"), F.col("event_type").alias("status"))
    history = accounts.Part(e.withColumn("followup", F.col("user_id") + 1_000_000), "followup", [F.col("at_s").desc(), F.col("event_id").desc()], ["event_id"])
    got = accounts.states(_table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], f, history, 4)
    return got.select("c_custkey", "status", F.array_join(F.transform("history", lambda i: i["event_id"].cast("string")), ",").alias("history"))


def status_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as follow-ups of their customers, the seven last, those of known status, and whether there were more."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    return accounts.status_index(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], ["F", "O"], 7).select("o_custkey", "o_orderkey", "status", "truncated")


def day_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last allowed number that each user's events say, for all customers."""
    said = _events(spark, sf_dir).select(F.col("user_id").alias("c_custkey"), "at_s", "event_id", (F.col("event_id") % 12).cast("int").alias("today_limit"))
    return accounts.preference(_table(spark, sf_dir, "customer"), "c_custkey", said, ["at_s", "event_id"], "today_limit", [3, 5, 8, 10], 5)


def emptied_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a nation's customers, eight for each, all of whom have less than a sum."""
    c = _table(spark, sf_dir, "customer").withColumn("grp", F.concat_ws("-", "c_nationkey", F.col("c_custkey") % 8))
    return accounts.left_empty(c, "grp", F.col("c_acctbal") < 9000)


def ledger_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discovered candidates; two of three are in the ledger, four of five are verified, at times by their numbers."""
    o, k, now = _table(spark, sf_dir, "orders"), F.col("o_orderkey"), 1_000_000
    d = o.select(k.alias("key"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderstatus").alias("title"), F.lit("d").alias("published_at"))
    e = o.where(k % 3 != 0).select(k.alias("key"), F.when(k % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("fingerprint"), F.when(k % 2 == 0, "VERIFIED").otherwise("FAILED").alias("status"), F.col("o_orderpriority").alias("verified_fingerprint"), (now - k % 900 * 100).alias("last_verified"), (now - k % 700 * 100).alias("last_seen"))
    c = o.where(k % 5 != 0).select(k.alias("key"), F.when(k % 11 == 0, "T").otherwise(F.col("o_orderstatus")).alias("title"), F.lit("d").alias("published_at"), (now + 2000 - k % 1000 * 100).alias("observed"))
    return ledger.bootstrapped(d, e, c, "key", F.lit(now), F.lit(now - 60_000), 86_400, F.col("key") % 13 != 0).groupBy("disposition").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("observed").alias("last_observed"))


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the dearest orders against itself, against one with two cards swapped, and against one that lacks its last card."""
    o = _table(spark, sf_dir, "orders")
    pool = ranking.top(o.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 500).select("o_orderkey", "rank")
    swapped = pool.withColumn("rank", F.when(F.col("rank") == 9, 10).when(F.col("rank") == 10, 9).otherwise(F.col("rank")))
    out = None
    for name, other in (("same", pool), ("swapped", swapped), ("short", pool.where("rank < 500"))):
        one = merge.snapshot_checks(pool, other, "o_orderkey", "rank").withColumn("snapshot", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def trial_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cards whose components are shown in percent, with fresh points by their size."""
    p = _table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    got = scoring.refreshed((k % 101).cast("int"), {"URGENCY": (k % 101).cast("double"), "FRESH": (k % 37).cast("double")}, {"URGENCY": size % 11, "FRESH": size % 8}, {"URGENCY": 10, "FRESH": 7})
    return p.select("p_partkey", got.alias("g")).select("p_partkey", "g.*")


def market_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' ids name a market; is it among those that their nation chose?"""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    key = F.concat(F.get(F.array(*map(F.lit, ["ccgp_bj_", "CCGP_LN_", "ccgp_tj_", "x_ccgp_he_", "ccgp_he_"])), (k % 5).cast("int")), k)
    choice = F.get(F.array(*map(F.lit, ["JJ", "JJJ", "NE3", "ALL", "TJ"])), (F.col("s_nationkey") % 5).cast("int"))
    return s.select("s_suppkey", text.market_of_id(key).alias("market"), F.array_contains(text.selected_markets(choice), text.market_of_id(key)).alias("chosen"))


QUERIES = {f.__name__: f for f in (payload_projection, page_coverage, as_of_values, benchmark_mentions, institution_scopes, specificity, scoped_rank, followed_list, url_status, account_lines, profile_lists, followup_states, status_index, day_limits, emptied_nations, ledger_bootstrap, snapshot_roundtrip, trial_percent, market_choice)}

_EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 AS at_s FROM events)"
_WEB = r"^(?i:https?):/*([^/?#:@\s]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"

ORACLE_SQL = {
    "payload_projection": f"""
        WITH {_EV}, r AS (SELECT *, floor(value)::BIGINT AS n, replace(props, ' ', '') AS z, lag(event_type) OVER w AS t0, lag(props) OVER w AS p0, lag(floor(value)::BIGINT) OVER w AS n0, row_number() OVER w AS nth FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id))
        SELECT event_id, sha256('{{"facts":{{"list":[1,{{"session_id":"' || event_type || '","y":null}}],"z":' || z || '}},"n":' || n || ',"type":"' || event_type || '"}}') AS mark, z,
               concat_ws(',', CASE WHEN nth = 1 OR t0 <> event_type OR p0 <> props THEN 'facts' END, CASE WHEN nth = 1 OR n <> n0 THEN 'n' END, CASE WHEN nth = 1 OR t0 <> event_type THEN 'type' END) AS changed, 'session_id' AS forbidden,
               sha256('{{"facts":{{"list":null,"z":null}},"n":' || n || ',"type":"' || event_type[:3] || '"}}') AS shown FROM r""",
    "page_coverage": rf"""
        WITH RECURSIVE p AS (SELECT page_id AS k, coalesce(html, '') AS h, CASE WHEN page_id % 7 <> 0 THEN page_id + page_id % 3 * 2 + 1 END AS f FROM pages),
        stored AS (SELECT k, any_value(f) AS f, any_value(regexp_extract_all(h, '(?is)<a\s[^>]*?href="([^"]+)"[^>]*>([^<]*)</a>', 1)[:400]) AS a FROM p WHERE k % 11 <> 4 GROUP BY k),
        walk(source, i, here, seen, found, a) AS (
            SELECT k, 1, k, [k], list_contains((SELECT list(k) FROM stored), k), list_distinct(coalesce((SELECT a FROM stored s WHERE s.k = p.k), [])) FROM p WHERE k % 5 = 0
            UNION ALL
            SELECT w.source, w.i + 1, s.f, list_append(w.seen, s.f), t.k IS NOT NULL, list_distinct(list_concat(w.a, coalesce(t.a, [])))
            FROM walk w JOIN stored s ON s.k = w.here LEFT JOIN stored t ON t.k = s.f
            WHERE w.found AND s.f IS NOT NULL AND NOT list_contains(w.seen, s.f) AND w.i < {MOST_PAGES} AND len(w.a) < {MOST_ANCHORS}),
        ended AS (SELECT w.*, s.f FROM walk w LEFT JOIN stored s ON s.k = w.here QUALIFY row_number() OVER (PARTITION BY source ORDER BY i DESC) = 1),
        told AS (SELECT *, found AND i = {MOST_PAGES} AND f IS NOT NULL AND NOT list_contains(seen, f) AND len(a) < {MOST_ANCHORS} AS limited FROM ended)
        SELECT source, array_to_string(CASE WHEN found THEN seen ELSE seen[:-2] END, ',') AS pages, i > 1 OR limited AS next_found, limited, NOT found AS partial,
               CASE WHEN limited THEN f::VARCHAR WHEN NOT found THEN here::VARCHAR END AS resume, len(a)::INT AS n_anchors FROM told""",
    "as_of_values": f"""
        WITH {_EV}, s AS (SELECT user_id, at_s, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL)
        SELECT e.event_id AS purchase, last_type, last_id FROM (SELECT * FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.at_s >= s.at_s""",
    "benchmark_mentions": "SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, lower(substr(text, 1, 40)) AS head FROM benchmark) ON length(head) >= 20 AND contains(lower(text), head)",
    "institution_scopes": """
        WITH i AS (SELECT 'o' AS owner, replace(lower(n_name), ' ', '') AS item, CASE n_nationkey % 3 WHEN 1 THEN 'building' WHEN 2 THEN 'machinery' ELSE '' END AS part, n_nationkey AS strength FROM nation),
        c AS (SELECT c_custkey, 'office' || replace(lower(n_name), ' ', '') AS name, lower(c_mktsegment) AS part FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT c_custkey, owner, strength FROM c JOIN i ON (contains(c.name, i.item) OR contains(i.item, c.name)) AND (i.part = '' OR contains(i.part, c.part) OR contains(c.part, i.part))""",
    "specificity": "SELECT p_partkey, least(8, CASE WHEN p_size > 25 THEN 4 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 2 ELSE 0 END + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT)::INT AS points FROM part",
    "scoped_rank": "SELECT o_orderkey, rank, rank <= 5 AS is_card FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders WHERE o_orderstatus = 'F') WHERE rank <= 500",
    "followed_list": f"""
        WITH {_EV}, l AS (SELECT * FROM ev WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) = 1)
        SELECT user_id % 50 AS owner, user_id, props AS note, at_s, row_number() OVER (PARTITION BY user_id % 50 ORDER BY at_s DESC, user_id)::INT AS place FROM l WHERE event_type <> 'error'""",
    "url_status": rf"""
        WITH u AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '{_WEB}', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '{_WEB}', 3), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '{_WEB}', 3), '/+$', '') END || regexp_extract(url, '{_WEB}', 4) AS c FROM pages),
        k AS (SELECT c, min(page_id) AS known FROM u WHERE page_id % 3 = 0 GROUP BY c)
        SELECT page_id, known, CASE WHEN known IS NULL THEN 'NEW' ELSE 'KNOWN' END AS status FROM u LEFT JOIN k USING (c)""",
    "account_lines": f"""
        WITH {_EV}
        SELECT c_custkey, 'account' AS part, NULL AS at, to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}})::VARCHAR AS line FROM customer
        UNION ALL SELECT o_custkey, 'followups', strftime(o_orderdate, '%Y-%m-%d'), to_json({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'day': strftime(o_orderdate, '%Y-%m-%d')}})::VARCHAR FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT user_id, 'followup_events', at_s::VARCHAR, to_json({{'event_id': event_id, 'event_type': event_type, 'props': props}})::VARCHAR FROM ev WHERE user_id IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT c_custkey, 'target_hospitals', 'x', to_json({{'n_name': n_name}})::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "profile_lists": f"""
        WITH {_EV}, o AS (SELECT o_custkey AS k, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS orders FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3) GROUP BY 1),
        e AS (SELECT user_id AS k, string_agg(event_id || ':' || event_type, ',' ORDER BY at_s DESC, event_id DESC) AS events FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) <= 2) GROUP BY 1)
        SELECT c_custkey, coalesce(orders, '') AS orders, coalesce(events, '') AS events FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey""",
    "followup_states": f"""
        WITH {_EV}, l AS (SELECT user_id, arg_max(event_type, (at_s, event_id)) AS status FROM ev GROUP BY 1),
        h AS (SELECT user_id, string_agg(event_id, ',' ORDER BY at_s DESC, event_id DESC) AS history FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) <= 4) GROUP BY 1)
        SELECT c_custkey, coalesce(status, 'NEW') AS status, coalesce(history, '') AS history FROM customer LEFT JOIN l ON l.user_id = c_custkey LEFT JOIN h ON h.user_id = c_custkey""",
    "status_index": """
        SELECT o_custkey, o_orderkey, status, had > 7 AS truncated FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS status, count(*) OVER (PARTITION BY o_custkey) AS had, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        WHERE n <= 7 AND status IN ('F', 'O')""",
    "day_limits": f"""
        WITH {_EV}, l AS (SELECT user_id, arg_max(event_id % 12, (at_s, event_id)) AS n FROM ev WHERE event_id % 12 IN (3, 5, 8, 10) GROUP BY 1)
        SELECT c_custkey, coalesce(n, 5)::INT AS today_limit FROM customer LEFT JOIN l ON user_id = c_custkey""",
    "emptied_nations": "SELECT c_nationkey || '-' || c_custkey % 8 AS grp, count(*) AS had FROM customer GROUP BY 1 HAVING bool_and(coalesce(c_acctbal < 9000, false))",
    "ledger_bootstrap": """
        WITH r AS (SELECT o_orderkey AS k, k % 3 <> 0 AS had, had AND k % 7 <> 0 AS same, same AND k % 2 = 0 AS verified, k % 11 <> 0 OR o_orderstatus = 'T' AS alike, k % 13 <> 0 AND alike AS fits, CASE WHEN k % 5 <> 0 THEN 1002000 - k % 1000 * 100 END AS seen FROM orders),
        d AS (SELECT *, CASE WHEN seen IS NULL OR seen > 1000000 THEN NULL WHEN 1000000 - seen > 86400 THEN 'STALE' WHEN had AND NOT same THEN 'METADATA_CHANGED' WHEN verified AND 1000000 - k % 900 * 100 >= seen THEN 'NEWER_VERIFIED'
                          WHEN had AND NOT verified AND 940000 >= seen THEN 'NEWER_STATE' WHEN NOT fits AND NOT same THEN 'METADATA_MISMATCH' WHEN NOT fits AND seen < 1000000 - k % 700 * 100 THEN 'BRIDGE_TOO_OLD' WHEN NOT fits THEN 'BRIDGED' ELSE 'SEEDED' END AS disposition FROM r)
        SELECT disposition, count(*) AS n, min(k) AS first_key, max(seen) AS last_observed FROM d GROUP BY 1""",
    "snapshot_roundtrip": """
        WITH n AS (SELECT least(500, count(*)) AS n FROM orders)
        SELECT 'same' AS snapshot, n AS local_count, n AS remote_count, true AS pool_ids, true AS card_ids, NULL::INT AS first_difference, true AS pool_count FROM n
        UNION ALL SELECT 'swapped', n, n, false, true, 9, true FROM n UNION ALL SELECT 'short', n, n - 1, false, true, 500, false FROM n""",
    "trial_percent": """
        SELECT p_partkey, greatest(0, least(100, p_partkey % 101 - floor((p_partkey % 101) / 100.0 * 10 + 0.5) - floor((p_partkey % 37) / 100.0 * 7 + 0.5) + p_size % 11 + p_size % 8))::INT AS score,
               floor((p_size % 11) / 10.0 * 100 + 0.5)::INT AS "URGENCY", floor((p_size % 8) / 7.0::DOUBLE * 100 + 0.5)::INT AS "FRESH" FROM part""",
    "market_choice": """
        WITH s AS (SELECT s_suppkey, ['BJ', 'LN', 'TJ', 'TJ', 'HE'][s_suppkey % 5 + 1] AS market, [['BJ', 'TJ'], ['BJ', 'TJ', 'HE'], ['LN', 'JL', 'HL'], ['BJ', 'TJ', 'HE', 'LN', 'JL', 'HL'], ['TJ']][s_nationkey % 5 + 1] AS m FROM supplier)
        SELECT s_suppkey, market, list_contains(m, market) AS chosen FROM s""",
}
