"""SQL for the queries of tables.py, written independently of them, in DuckDB's dialect."""

from __future__ import annotations

_EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 AS at_s FROM events)"


def _pool(as_of: str = "2001-07-15 00:00:00", name: str = "pool") -> str:
    return f"""
    {name}_dated AS (
        SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) // 1000000 AS published,
               epoch_us(o_orderdate) // 1000000 + 86400 * CASE left(o_orderpriority, 1) WHEN '1' THEN 7 WHEN '2' THEN 14 WHEN '3' THEN 30 WHEN '4' THEN 60 WHEN '5' THEN 90 END AS deadline,
               epoch_us(TIMESTAMP '{as_of}') // 1000000 AS now_s
        FROM orders),
    {name}_points AS (
        SELECT *, coalesce(deadline > now_s, false) AS is_open, (deadline - now_s) / 3600.0 AS hours, floor((now_s - published) / 86400.0) AS days
        FROM {name}_dated WHERE published <= now_s),
    {name} AS (
        SELECT *, CASE WHEN is_open THEN 25 ELSE 0 END AS win,
               CASE WHEN NOT is_open THEN 0 WHEN hours <= 24 THEN 10 WHEN hours <= 72 THEN 9 WHEN hours <= 168 THEN 7 WHEN hours <= 336 THEN 5 WHEN hours <= 720 THEN 3 ELSE 1 END AS urg,
               CASE WHEN o_totalprice >= 400000 THEN 10 WHEN o_totalprice >= 250000 THEN 9 WHEN o_totalprice >= 100000 THEN 7 WHEN o_totalprice >= 50000 THEN 4 WHEN o_totalprice > 0 THEN 2 ELSE 0 END AS amt,
               CASE WHEN days < 0 THEN 0 WHEN days <= 1 THEN 7 WHEN days <= 3 THEN 6 WHEN days <= 7 THEN 5 WHEN days <= 14 THEN 3 WHEN days <= 30 THEN 1 ELSE 0 END AS fre,
               (win + urg + amt + fre)::INT AS score
        FROM {name}_points)"""


_ORDER = "score DESC, deadline ASC NULLS LAST, published DESC, o_orderkey"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE length({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _fields(*names: str) -> str:
    return " || '|' || ".join(_FIELD.format(n) for n in names)


_TEXT_URL = r"^(?i)(https?):/*(?:[^/?#@]*@)?([^/?#:@\s]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"

ORACLE_SQL = {
    "ranked_pool_top": f"WITH {_pool()} SELECT o_orderkey, score, deadline, published, row_number() OVER (ORDER BY {_ORDER})::INT AS rank FROM pool WHERE is_open QUALIFY rank <= 500",
    "market_scoped_rank": f"""
        WITH {_pool()} SELECT n_regionkey, o_orderkey, score, row_number() OVER (PARTITION BY n_regionkey ORDER BY {_ORDER})::INT AS rank
        FROM pool JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey QUALIFY rank <= 50""",
    "personalised_rank": f"""
        WITH {_pool()}, t AS (
            SELECT o_orderkey, score, (CASE WHEN c_acctbal > 7500 THEN 10 WHEN c_acctbal > 5000 THEN 7 WHEN c_acctbal > 2500 THEN 4 WHEN c_acctbal > 0 THEN 2 ELSE 0 END
                   + CASE WHEN c_mktsegment = 'BUILDING' THEN 25 ELSE 0 END)::INT AS private, least(100, score + private)::INT AS total
            FROM pool JOIN customer ON c_custkey = o_custkey)
        SELECT *, row_number() OVER (ORDER BY total DESC, score DESC, o_orderkey)::INT AS rank FROM t QUALIFY rank <= 500""",
    "runtime_rescore": f"""
        WITH {_pool()}, {_pool("2001-07-29 00:00:00", "later")}
        SELECT a.o_orderkey, a.score, (b.win + b.urg + a.amt + b.fre)::INT AS score_later FROM pool a JOIN later b USING (o_orderkey)""",
    "keyed_last_wins": f"WITH {_EV} SELECT user_id, event_type, at_s, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_s DESC, event_id DESC) = 1",
    "first_wins_dedupe": "SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "scd2_versions": f"""
        WITH {_EV}, c AS (SELECT *, lag(event_type) OVER w AS had, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id))
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id)::INT AS version, event_type, at_s, event_id FROM c WHERE n = 1 OR event_type IS DISTINCT FROM had""",
    "scd2_strict": f"""
        WITH {_EV}, c AS (SELECT *, lag(event_type) OVER w AS had, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id)),
        v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id)::INT AS version, event_type, at_s, event_id FROM c WHERE n = 1 OR event_type IS DISTINCT FROM had)
        SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY version) = 1""",
    "version_diff": f"""
        WITH {_EV}, l AS (SELECT event_id, event_type, props, floor(value)::BIGINT AS lv, lag(event_type) OVER w AS e0, lag(props) OVER w AS p0, lag(floor(value)::BIGINT) OVER w AS l0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id))
        SELECT event_id, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM e0 THEN 'event_type' END, CASE WHEN lv IS DISTINCT FROM l0 THEN 'level' END, CASE WHEN props IS DISTINCT FROM p0 THEN 'props' END) AS changed FROM l""",
    "event_fold_as_of": f"""
        WITH {_EV}, k AS (
            SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN 'h' || ((at_s % 86400) // 3600) END AS path,
                   event_type = 'signup' AND coalesce(value, 0) > 100 AS term FROM ev WHERE at_s <= 1705708800),
        p AS (SELECT user_id, path, arg_max(event_type, (at_s, event_id)) AS last, arg_max(floor(value)::BIGINT::VARCHAR, (at_s, event_id)) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS v FROM k WHERE path IS NOT NULL GROUP BY ALL),
        u AS (SELECT user_id, bool_or(term) AS terminated, count(*)::BIGINT AS n_events FROM k GROUP BY user_id)
        SELECT u.user_id, coalesce((SELECT string_agg(path || '=' || v, ',' ORDER BY path) FROM p WHERE p.user_id = u.user_id AND v IS NOT NULL), '') AS overrides,
               terminated OR EXISTS (FROM p WHERE p.user_id = u.user_id AND last = 'error') AS suppressed, terminated, n_events FROM u""",
    "state_json_agg": f"""
        WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) AS p FROM ev QUALIFY p <= 20)
        SELECT user_id, '[' || string_agg('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}', ',' ORDER BY p) || ']' AS items FROM n GROUP BY user_id""",
    "latest_per_group": f"WITH {_EV} SELECT user_id, event_id, at_s, value FROM ev WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) = 1",
    "page_lookahead": """
        WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 101 OFFSET 100),
        n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place, count(*) OVER () > 100 AS has_more FROM p)
        SELECT * FROM n WHERE place <= 100""",
    "set_delta": """
        WITH y AS (SELECT year(o_orderdate) AS y, o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL)
        SELECT o_custkey, CASE WHEN bool_and(y = 1997) THEN 'new' WHEN bool_and(y = 1996) THEN 'removed' WHEN min(n) = max(n) THEN 'reused' ELSE 'changed' END AS state FROM y GROUP BY o_custkey""",
    "outcome_summary": """
        SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS won, count_if(o_orderstatus = 'O')::BIGINT AS lost, count_if(o_orderstatus = 'P')::BIGINT AS unfit, count(*) AS n_rows,
               CASE WHEN won + lost > 0 THEN floor(won * 100.0 / (won + lost) + 0.5)::BIGINT END AS win_rate FROM orders GROUP BY o_orderpriority""",
    "reason_histogram": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'UNCLASSIFIED' END AS reason, count(*) AS n_rows FROM orders GROUP BY 1",
    "feedback_rate": "SELECT count(quality) AS responded, count_if(quality = 1)::BIGINT AS effective, floor(count_if(quality = 1) * 100.0 / nullif(count(quality), 0) + 0.5)::BIGINT AS rate FROM labels",
    "coverage_risk": """
        SELECT source, risk, count(*) AS n_rows FROM (
            SELECT source, 'SHORT' AS risk FROM documents WHERE n_chars < 500 UNION ALL SELECT source, 'LONG' FROM documents WHERE n_chars > 20000
            UNION ALL SELECT source, 'FOREIGN' FROM documents WHERE lang <> 'en') GROUP BY ALL""",
    "trailing_runs": f"""
        WITH {_EV}, r AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) AS broken FROM ev)
        SELECT user_id, count(*) AS n_rows, count_if(broken = 0)::BIGINT AS run FROM r GROUP BY user_id""",
    "finding_ledger": f"""
        WITH {_EV}, s AS (SELECT user_id, event_type, min(at_s) AS first_seen, max(at_s) AS last_seen, count(*) AS times_seen FROM ev GROUP BY ALL)
        SELECT *, last_seen = max(last_seen) OVER (PARTITION BY user_id) AS active FROM s""",
    "content_fingerprint": f"""
        WITH r AS (SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS region_mark FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey)
        SELECT c_custkey, sha256({_fields('c_name', 'c_mktsegment', 'c_nationkey')}) AS mark, 'cust_' || left(sha256(c_name), 16) AS stable, region_mark
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN r USING (n_regionkey)""",
    "change_reasons": f"""
        WITH {_EV}, l AS (SELECT event_id, event_type, at_s, lag(event_type) OVER w AS e0, lag(at_s) OVER w AS a0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id))
        SELECT event_id, (CASE WHEN a0 IS NULL THEN 0 WHEN event_type <> e0 THEN 1 WHEN at_s - a0 >= 43200 THEN 3 END)::INT AS reason FROM l""",
    "scan_bucket": f"WITH {_EV} SELECT event_type, at_s // 10800 AS bucket, min(event_id) AS event_id FROM ev GROUP BY ALL",
    "first_hit_windows": f"""
        WITH RECURSIVE {_EV}, starts(user_id, s) AS (
            SELECT user_id, min(at_s) FROM ev GROUP BY user_id
            UNION ALL SELECT starts.user_id, min(ev.at_s) FROM starts JOIN ev ON ev.user_id = starts.user_id AND ev.at_s >= s + 86400 GROUP BY starts.user_id),
        w AS (SELECT ev.user_id, at_s, max(s) AS window_start, any_value(event_id) AS event_id FROM ev JOIN starts ON ev.user_id = starts.user_id AND s <= at_s GROUP BY ev.user_id, at_s, event_id)
        SELECT user_id, at_s AS at, window_start, row_number() OVER (PARTITION BY user_id, window_start ORDER BY at_s)::INT AS hits, hits > 3 AS limited FROM w""",
    "rate_limit": f"""
        WITH {_EV} SELECT event_id, at_s // 3600 * 3600 AS window_start, row_number() OVER (PARTITION BY event_type, at_s // 3600 ORDER BY at_s, event_id)::INT AS hits, hits > 3 AS limited FROM ev""",
    "verification_budget": f"""
        WITH {_EV}, s AS (
            SELECT *, at_s < 1704412800 AS old, row_number() OVER (PARTITION BY event_type, at_s < 1704412800 ORDER BY value DESC, at_s DESC, event_id) AS p,
                   count_if(at_s >= 1704412800) OVER (PARTITION BY event_type) AS c, count_if(at_s < 1704412800) OVER (PARTITION BY event_type) AS k
            FROM ev WHERE value IS NOT NULL),
        a AS (SELECT *, CASE WHEN k > 0 THEN least(k, greatest(1, 60 // 4)) ELSE 0 END AS r FROM s),
        b AS (SELECT *, least(c, greatest(0, 60 - r)) AS s0 FROM a),
        d AS (SELECT *, r + least(k - r, 60 - s0 - r) AS kk FROM b)
        SELECT event_id, event_type, p <= CASE WHEN old THEN kk ELSE s0 + least(c - s0, 60 - s0 - kk) END AS selected FROM d""",
    "due_source": f"""
        WITH {_EV}, s AS (SELECT event_type, max(at_s) AS completed, count(*) AS n FROM ev GROUP BY event_type)
        SELECT event_type, completed, 1706745600 - completed - CASE WHEN n % 2 = 0 THEN 7200 ELSE 3600 END AS overdue FROM s
        WHERE overdue >= 0 ORDER BY overdue DESC, event_type LIMIT 1""",
    "tick_grid": """
        WITH e AS (SELECT ts + INTERVAL 8 HOURS AS t FROM events),
        m AS (SELECT strftime(t, '%Y-%m-%d') AS day, hour(t) * 60 + minute(t) AS m FROM e),
        d AS (SELECT day, CASE WHEN m < 690 THEN 690 ELSE 690 + ((m - 690) // 15 + 1) * 15 END AS due FROM m)
        SELECT day, minute_of_day, count(*) AS n_events, ((minute_of_day - 690) // 15)::INT AS tick FROM (SELECT day, CASE WHEN due <= 1140 THEN due END::INT AS minute_of_day FROM d) GROUP BY ALL""",
    "lineage_pairs": """
        SELECT i.o_orderkey AS intent_key, f.o_orderkey AS formal_key, row_number() OVER (PARTITION BY i.o_orderkey ORDER BY f.o_orderdate, f.o_orderkey)::INT AS place
        FROM orders i JOIN orders f ON i.o_custkey = f.o_custkey AND i.o_orderpriority = f.o_orderpriority AND f.o_orderdate >= i.o_orderdate
        WHERE i.o_orderstatus = 'P' AND f.o_orderstatus = 'F' QUALIFY place <= 3""",
    "containment_join": """
        SELECT p_partkey, keyword, kind FROM part JOIN (VALUES ('blue', 'colour'), ('red', 'colour'), ('steel', 'material'), ('1', 'digit'), ('part', 'noun')) k(keyword, kind)
        ON CASE WHEN length(keyword) <= 3 THEN regexp_matches(lower(p_name), '(^|[^a-z0-9])' || keyword || '($|[^a-z0-9])') ELSE contains(lower(p_name), keyword) END""",
    "scope_match": """
        WITH s AS (SELECT n_name, max(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
        SELECT c_custkey, max(balance) AS best, count(s.n_name) AS n_matches
        FROM customer JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN s ON contains('office ' || n.n_name, s.n_name) OR contains(s.n_name, 'office ' || n.n_name) GROUP BY c_custkey""",
    "scope_classifier": r"""
        WITH t AS (SELECT doc_id, lang, source, text, lower(text) AS l FROM documents),
        c AS (SELECT *, contains(l, 'version') OR contains(l, 'from') AS near, near OR contains(lower(source), 'version') OR contains(lower(source), 'from') AS around FROM t)
        SELECT doc_id, CASE WHEN contains(l, 'password') OR contains(l, 'ssn') THEN 'HARD_EXCLUSION'
               WHEN contains(l, 'license') OR regexp_matches(text, '(^|[^A-Za-z0-9])(?i:GNU|MIT)($|[^A-Za-z0-9])') THEN 'IN'
               WHEN contains(l, '%%%') OR contains(l, '***') THEN 'GENERIC_EXCLUSION'
               WHEN contains(l, 'tion of') THEN CASE WHEN near THEN 'IN' ELSE 'ADJACENT_WITHOUT_CONTEXT' END
               WHEN contains(l, 'the the') THEN CASE WHEN around THEN 'IN' ELSE 'CONTEXT_MISSING' END ELSE 'NO_TERM' END AS scope,
               NOT (contains(text, 'Released') OR contains(text, 'src1') OR contains(source, 'src1')) AS is_primary FROM c""",
    "url_canonical": rf"""
        WITH g AS (SELECT page_id, url, regexp_extract(trim(url), '{_TEXT_URL}', ['scheme', 'host', 'port', 'path', 'query']) AS p FROM pages)
        SELECT page_id, CASE WHEN p.host <> '' AND NOT regexp_matches(url, '^[a-zA-Z]+:/*[^/?#@]+@') AND (p.port IN ('', '443') OR (p.port = '80' AND lower(p.scheme) = 'http'))
               THEN 'https://' || lower(p.host) || coalesce(nullif(rtrim(p.path, '/'), ''), '/') || p.query END AS canonical,
               coalesce(nullif(lower(p.host), ''), 'unknown-public-source') AS host FROM g""",
    "anchor_extract": r"""
        WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]+)"[^>]*>([^<]*)</a>', 1) AS us, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]+)"[^>]*>([^<]*)</a>', 2) AS ts FROM pages)
        SELECT page_id, unnest(range(least(len(us), 400)))::INT AS place, unnest(us[:400]) AS url, trim(unnest(ts[:400])) AS title FROM a""",
    "validation_codes": """
        SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'TEXT_MISSING' WHEN coalesce(lang NOT IN ('en', 'de', 'fr'), true) THEN 'LANG'
               WHEN coalesce(n_chars <> length(text), true) THEN 'SIZE' WHEN n_chars < 100 THEN 'SHORT' END AS error_code FROM documents""",
    "repeated_keys": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "grounding_metrics": """
        WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'UNGROUNDED' WHEN doc_id % 5 = 0 THEN 'INVALID' END AS r FROM labels), g AS (SELECT doc_id FROM documents WHERE lang = 'en'),
        c AS (SELECT count(*) AS raw, count_if(r = 'UNGROUNDED')::BIGINT AS rejected_ungrounded, count_if(r = 'INVALID')::BIGINT AS rejected_invalid, count(DISTINCT doc_id) FILTER (r IS NULL) AS candidates FROM o),
        h AS (SELECT count(DISTINCT doc_id) AS hits FROM o JOIN g USING (doc_id) WHERE r IS NULL), n AS (SELECT count(DISTINCT doc_id) AS gold FROM g)
        SELECT raw, rejected_ungrounded, rejected_invalid, gold, candidates, hits, candidates - hits AS novel, round(hits / gold, 4) AS recall, round((raw - rejected_ungrounded) / raw, 4) AS grounding,
               round((raw - rejected_ungrounded - rejected_invalid) / raw, 4) AS format_valid, round(100 * (0.75 * hits / gold + 0.2 * (raw - rejected_ungrounded) / raw + 0.05 * (raw - rejected_ungrounded - rejected_invalid) / raw), 1) AS score
        FROM c, h, n""",
    "grounded_outputs": f"""
        WITH {_EV} SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'URL_NOT_ALLOWED' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'KIND'
               WHEN value IS NULL OR value / 100 NOT BETWEEN 0 AND 1 THEN 'CONFIDENCE' WHEN coalesce(trim(props), '') = '' THEN 'REASON' END AS rejected
        FROM ev LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0""",
    "export_bundle": " UNION ALL ".join(f"SELECT '{t}' AS part, count(*) AS n_rows FROM {t}" for t in ("customer", "events", "labels", "nation", "orders", "part", "region", "supplier")),
    "session_join": """
        SELECT c_mktsegment, count(*) AS n_orders, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' GROUP BY c_mktsegment""",
    "idempotent_states": f"""
        WITH {_EV}, o AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, at_s // 7200 ORDER BY at_s, event_id) = 1),
        e AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN (at_s, event_id) END) OVER (PARTITION BY user_id) AS ended FROM o)
        SELECT user_id, arg_max(event_type, (at_s, event_id)) AS event_type,
               CASE WHEN arg_max(event_type, (at_s, event_id)) <> 'purchase' THEN arg_max(at_s, (at_s, event_id)) FILTER (event_type = 'view' AND (ended IS NULL OR (at_s, event_id) > ended)) END AS reminder
        FROM e GROUP BY user_id""",
    "carry_over": f"""
        WITH {_EV} SELECT user_id, max(at_s) AS seen FROM ev WHERE at_s <= 1706000000
        AND user_id NOT IN (SELECT user_id FROM ev WHERE at_s BETWEEN 1705996400 AND 1706000000) GROUP BY user_id HAVING 1706000000 - max(at_s) <= 48 * 3600""",
    "upsert_versions": f"""
        WITH {_EV}, o AS (SELECT user_id, arg_max(event_type, (at_s, event_id)) AS had FROM ev WHERE at_s < 1705000000 GROUP BY user_id),
        n AS (SELECT user_id, arg_max(event_type, (at_s, event_id)) AS fact_hash, max(at_s) AS seen FROM ev GROUP BY user_id)
        SELECT user_id, fact_hash, seen, CASE WHEN had IS NULL THEN 'create' WHEN seen < 1705000000 THEN 'stale' WHEN had = fact_hash THEN 'touch' ELSE 'version' END AS action,
               (CASE WHEN had IS NOT NULL AND seen >= 1705000000 AND had <> fact_hash THEN 2 ELSE 1 END)::INT AS version FROM n LEFT JOIN o USING (user_id)""",
}
