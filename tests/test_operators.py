"""Record operators on small tables where the right answer is plain."""

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import html, text, times
from sievegrid.operators import analytics, events, ledger, matching, merge, ranking, scoring, validate


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    L = F.lit
    r = one(
        spark, a=text.collapse(L("  a  \n b ")), b=text.match_key(L(" 天津（市） Hospital-1 ")), c=text.capped(L("   "), 5), d=text.official_url(L("http://Ex.COM:80/a/b/?q=1#top")),
        e=text.official_url(L("ftp://x")), f=text.flag_value(F.array(L("X"), L("MONTH=2024-05")), "MONTH"), g=text.budget_cny(L("预算 12.5万元")), h=text.budget_cny(L("1,200,000元")),
        i=text.phone(L("12-3")), j=text.phone(L("022-12345")), k=text.section(L("一、内容 abc 二、其他"), "一、内容", "二、"), l=text.quantity(L(" 3 套")), m=text.split_names(L("a、b，a, c")),
        n=text.set_fingerprint(F.array(L("b"), L("a"))) == text.set_fingerprint(F.array(L("a"), L("b"))), o=text.fingerprint(L("a|b"), L("c")) == text.fingerprint(L("a"), L("b|c")), p=text.region_code(L("天津市西青区")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("a b", "天津市hospital1", None, "https://ex.com/a/b?q=1", None, "2024-05")
    assert (r.g, r.h, r.i, r.j, r.k, r.l, r.m, r.n, r.o, r.p) == (125_000, 1_200_000, None, "022-12345", "abc", "3 套", ["a", "b", "c"], True, False, "CN-TJ")


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = one(
        spark, a=times.instant(F.lit("2024-01-01T00:00:00")).isNull(), b=times.is_date(F.lit("2024-02-30")), c=times.local_date(ts("2024-01-01 20:00:00")).cast("string"),
        d=times.end_of_day(F.lit("2024-01-02").cast("date")).cast("string"), e=times.next_deadline(ts("2024-01-02 00:00:00"), ts("2024-01-02 00:00:00"), ts("2024-01-03 00:00:00")).cast("string"),
        f=times.month_phase(F.lit("2024年3月至5月"), ts("2024-05-31 00:00:00")), g=times.freshness(ts("2024-01-02 00:00:00"), ts("2024-01-01 00:00:00"))["freshness"], h=times.scan_bucket(F.lit("1970-01-01 03:00:00").cast("timestamp_ntz"), 180),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, "2024-01-02", "2024-01-02 15:59:59.999", "2024-01-03 00:00:00")
    assert (r.f, r.g, r.h) == ("ACTIVE", "INVALID", 1)


def test_html(spark):
    page = '<p>a&amp;b<script>var t="</p>";</script></p><a href="/x#1">One <b>two</b></a><a href="/x">again</a><table><tr><th rowspan=2>名称</th><th colspan=2>数量</th></tr><tr><td>1</td><td>2<table><tr><td>in</td></tr></table></td></tr></table>'
    df = spark.createDataFrame([(page, "https://h.example/"), (None, None)], "h string, b string")
    r, empty = df.select(html.visible_text("h").alias("t"), html.anchors("h", "b").alias("a"), html.tables("h").alias("g")).collect()
    assert r.t.split("\n")[0] == "a&b" and [tuple(x) for x in r.a] == [("One two", "https://h.example/x")]
    assert r.g[0][0] == ["名称", "数量", "数量"] and r.g[0][1][:2] == ["名称", "1"] and len(r.g) == 1
    assert (empty.t, empty.a, empty.g) == ("", [], [])
    grid = F.array(*[F.array(*map(F.lit, row)) for row in (["x", "y"], ["名称", "数量"], ["床", "2台"], ["床", "2台"], ["", "1"])])
    assert [tuple(x) for x in one(spark, p=html.product_rows(grid, ["名称"], ["数量"])).p] == [("床", "2台")]
    assert one(spark, d=html.decode_best(F.lit("医院".encode("gb18030")))).d == "医院"


def test_actionability_boundaries(spark):
    none = F.lit(None).cast("long")

    def mode(**k):
        of = lambda n: F.lit(k[n]).cast("long") if n in k else none
        return one(spark, a=scoring.actionability(F.lit(100), F.lit(10), F.lit(k.get("state", "BIDDING")), of("bid"), of("reg"), of("day"), of("rel"), served=k.get("served", False)))["a"]["mode"]

    assert mode(bid=100) == "ARCHIVE" and mode(bid=101) == "PUBLIC_OPPORTUNITY"
    assert mode(reg=100) == "ARCHIVE" and mode(reg=100, bid=200) == "LATE_WINDOW"
    assert mode(day=10) == "PUBLIC_OPPORTUNITY" and mode(day=9) == "ARCHIVE" and mode(day=9, bid=200) == "LATE_WINDOW"
    assert mode(day=9, reg=101) == "PUBLIC_OPPORTUNITY"  # a known instant overrides the day
    assert mode(rel=100) == "ARCHIVE" and mode(rel=100, bid=200) == "ARCHIVE" and mode(rel=101) == "PUBLIC_OPPORTUNITY"
    assert mode(state="PROCUREMENT_INTENT") == "PRE_MARKET_SIGNAL" and mode(state="PROCUREMENT_INTENT", served=True) == "PUBLIC_OPPORTUNITY"
    r = one(spark, a=scoring.deadline_points(F.lit(24.0)), b=scoring.amount_points(F.lit(None).cast("long")), c=scoring.freshness_points(F.lit(-1)), d=scoring.percent(F.lit(1), F.lit(0)), e=scoring.personalised(F.lit(90), F.lit(5), F.lit(40)), f=scoring.deadline_points(F.lit(-0.5)))
    assert tuple(r) == (10, 0, 0, None, 100, 0)


def test_labels_and_points(spark):
    L = F.lit
    r = one(spark, a=F.array(*[scoring.tier(L(x)) for x in (90, 89, 75, 60, 59)]), b=F.array(*[times.urgency(L(float(x))) for x in (0, 24, 25, 73, 169, 337, 721)]), c=times.urgency(L(None).cast("double")), d=F.array(*[scoring.relationship_points(L(x)) for x in ("STRONG", "MEDIUM", "HISTORICAL", "WEAK", "GOOD")]))
    assert r.a == ["critical", "high", "high", "medium", "low"] and r.b == ["H24", "H24", "H72", "D7", "D14", "D30", "GT30D"]
    assert (r.c, r.d) == ("NO_DEADLINE", [10, 7, 4, 2, 0])
    ts = lambda s: L(s).cast("timestamp")
    now = ts("2024-01-03 00:00:00")
    fresh = [times.freshness(ts(x), now) for x in ("2024-01-01 18:00:00", "2024-01-01 17:59:00", "2024-01-03 00:15:00", "2024-01-03 00:15:01")]
    assert [tuple(x) for x in one(spark, a=F.array(*fresh)).a] == [("FRESH", 1800), ("STALE", 1801), ("FRESH", 0), ("INVALID", None)]
    phases = [times.month_phase(L(x), ts("2024-05-31 17:00:00")) for x in ("2024年6月", "2024年4月-5月", "2024年13月", "soon", "2024年7至9月")]
    assert one(spark, a=F.array(*phases)).a == ["ACTIVE", "AFTER", "UNKNOWN", "UNKNOWN", "BEFORE"]
    titles = [scoring.specific_title(L(x)) for x in ("一台CT采购", "CTX", "内镜清洗", "")]
    assert one(spark, a=F.array(*titles)).a == [True, False, True, False]


def test_addresses(spark):
    L, base = F.lit, F.lit("https://h.example/a/b.html?x=1#y")
    urls = ["http://H.example:80/x/", "https://h.example", "https://u:p@h.example/", "https://h.example:8443/", "https://h.example:443/a#b", "../c/", "./d", "//h.example/e", "?q", "/f/../g", "ftp://h.example/", "javascript:1", "https://other.example/"]
    got = one(spark, a=F.array(*[text.official_url(L(u), base, ["h.example"]) for u in urls])).a
    h = "https://h.example"
    assert got == [f"{h}/x", f"{h}/", None, None, f"{h}/a", f"{h}/c", f"{h}/a/d", f"{h}/e", f"{h}/a/b.html?q", f"{h}/g", None, None, None]
    assert one(spark, a=F.array(*[text.canonical_https(L(u)) for u in ("HTTPS://U@A.b:9/C#d", "http://a/", "https:///x")])).a == ["https://u@a.b:9/C", None, None]
    quantities = {"3": True, "三": True, "2台": True, "1.5 套": True, "1(一批)": True, "二十项服务": True, "约3台": False, "": False, "3只": False}
    assert one(spark, a=F.array(*[text.is_quantity(L(x)) for x in quantities])).a == list(quantities.values())
    assert one(spark, a=text.fnv1a(L("a"), 1 << 31), b=text.fnv1a(L(""), 1000), c=text.fnv1a(L("医a"), 97)).asDict() == {"a": 0xE40C292C % (1 << 31), "b": 2166136261 % 1000, "c": ((((2166136261 ^ 0x533B) * 16777619 % 2**32) ^ 97) * 16777619 % 2**32) % 97}
    assert one(spark, a=F.array(*[text.amount_shown(L(x)) for x in (9_999, 10_000, 125_500)])).a == ["¥9,999", "1 万元", "12.6 万元"]


@pytest.mark.parametrize(("current", "carried", "cap"), [(0, 5, 4), (9, 0, 4), (9, 9, 8), (1, 9, 8), (3, 1, 4), (0, 0, 3), (9, 9, 1)])
def test_budget_slots(spark, current, carried, cap):
    rows = [("s", i, False) for i in range(current)] + [("s", 100 + i, True) for i in range(carried)]
    df = spark.createDataFrame(rows, "source string, i int, old boolean")
    got = ranking.budgeted(df, "source", F.col("old"), [F.col("i")], cap, ["i"]).where("selected").collect()
    assert len(got) == min(cap, current + carried)
    assert not carried or sum(r.old for r in got) >= min(carried, max(1, cap // 4))


def plain_merge(rows):
    slots = []
    for row in rows:
        hits = [i for i, s in enumerate(slots) if s and (s[1] == row[1] or s[2] == row[2])]
        if not hits:
            slots.append(row)
        else:
            slots[hits[0]] = row
            for i in hits[1:]:
                slots[i] = None
    return sorted(s for s in slots if s)


def test_merge_by_two_keys(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"i{rng.randrange(12)}", f"n{rng.randrange(12)}") for i in range(60)]
    df = spark.createDataFrame([("m", *r) for r in rows], "market string, seq int, id string, number string")
    got = merge.merge_by_two_keys(df, "market", "seq", "id", "number").collect()
    assert sorted((r.seq, r.id, r.number) for r in got) == plain_merge(rows)
    assert all(r.slot <= r.seq for r in got)


def test_merge_of_a_whole_table(spark):
    """All order lines, against one dictionary; and one component in many batches."""
    from sievegrid.plans import tables

    sf = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").collect()
    slots, by_id, by_number = {}, {}, {}
    for r in sorted(lines, key=lambda r: f"{r.l_orderkey:012}-{r.l_linenumber:04}-{r.l_partkey:08}-{r.l_suppkey:06}"):
        seq, name, number = f"{r.l_orderkey:012}-{r.l_linenumber:04}-{r.l_partkey:08}-{r.l_suppkey:06}", f"{r.l_suppkey}-{r.l_orderkey}", (r.l_suppkey, r.l_partkey)
        hits = {by_id.get(name), by_number.get(number)} - {None}
        for h in hits:
            _, n, w = slots.pop(h)
            del by_id[n], by_number[w]
        at = min(hits, default=seq)
        slots[at], by_id[name], by_number[number] = (seq, name, number), at, at
    got = tables.QUERIES["dual_key_merge"](spark, sf).collect()
    assert sorted((r.slot, r.seq) for r in got) == sorted((s, v[0]) for s, v in slots.items()) and len(lines) > 50_000
    rows = [("m", i, f"i{i // 2}", f"n{(i + 1) // 2 % 20_000}") for i in range(50_000)]
    one = merge.merge_by_two_keys(spark.createDataFrame(rows, "market string, seq int, id string, number string"), "market", "seq", "id", "number")
    assert sorted((r.seq, r.id, r.number) for r in one.collect()) == plain_merge([r[1:] for r in rows])


def test_ids_meet_across_markets(spark):
    rows = [("a", 1, "i1", "n1"), ("b", 2, "i1", "n2"), ("a", 3, None, "n1"), ("b", 4, "i2", "n2"), ("c", 5, None, None), ("c", 6, None, None), ("b", 7, "i9", "n1")]
    df = spark.createDataFrame(rows, "market string, seq int, id string, number string")
    got = {(r.market, r.seq, r.slot) for r in merge.merge_by_two_keys(df, "market", "seq", "id", "number").collect()}
    # the second takes the first's slot by its id; then n1 is free for the third, and n2 leads the fourth to the first slot
    assert got == {("b", 4, 1), ("a", 3, 3), ("c", 5, 5), ("c", 6, 6), ("b", 7, 7)}


def test_versions_and_upserts(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("AABBA")], "key string, at int, fact string")
    assert [r.version for r in merge.versions(df, "key", ["at"], F.col("fact")).orderBy("at").collect()] == [1, 2, 3]
    assert [r.version for r in merge.versions(df, "key", ["at"], F.col("fact"), strict=True).orderBy("at").collect()] == [1, 2]
    now = spark.createDataFrame([("a", "h", 2, 10), ("b", "h", 2, 10), ("c", "h", 2, 10)], "key string, fact_hash string, version int, last_seen long")
    seen = spark.createDataFrame([("a", "h", 10), ("b", "g", 9), ("c", "g", 10), ("d", "x", 1)], "key string, fact_hash string, seen long")
    got = {r.key: (r.action, r.version) for r in merge.upsert_versions(now, seen, "key").collect()}
    assert got == {"a": ("touch", 2), "b": ("stale", 2), "c": ("version", 3), "d": ("create", 1)}
    snap = merge.snapshot_conflicts(spark.createDataFrame([(1, "a"), (2, "b")], "as_of int, hash string"), spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "as_of int, hash string"))
    assert {r.as_of: r.state for r in snap.collect()} == {1: "same", 2: "conflict", 3: "insert"}


def test_event_fold(spark):
    rows = [("p", 1, "d", "old", False, False, False), ("p", 2, "d", "new", False, False, False), ("q", 1, "d", None, True, False, False), ("q", 2, "d", "x", False, False, False), ("r", 1, "d", "x", False, True, False), ("s", 1, None, None, False, False, True), ("p", 9, "d", "late", False, False, False)]
    df = spark.createDataFrame(rows, "k string, at int, path string, value string, open boolean, sticky boolean, end boolean")
    state = events.fold(df, ["k"], ["at"], F.lit(5), "at", *[F.col(c) for c in ("path", "value", "open", "sticky", "end")])
    got = {r.k: (r.overrides, r.suppressed) for r in state.collect()}
    assert got == {"p": ({"d": "new"}, False), "q": ({"d": "x"}, False), "r": ({"d": "x"}, True), "s": ({}, True)}
    records = spark.createDataFrame([("p", "was", 1), ("s", "was", 2), ("z", "was", 3)], "k string, d string, n int")
    assert sorted(map(tuple, events.applied(records, state, ["k"], ["d"]).collect())) == [("p", "new", 1), ("z", "was", 3)]


def test_matching(spark):
    terms = {"hard": ["车辆"], "strong": ["监护仪"], "generic": ["维修"], "adjacent": ["软件"], "contextual": ["系统"], "context": ["医院"], "acronyms": ["CT", "DR"]}
    cases = {"监护仪维修": "IN", "车辆 监护仪": "HARD_EXCLUSION", "空调维修": "GENERIC_EXCLUSION", "软件": "ADJACENT_WITHOUT_CONTEXT", "医院软件": "IN", "系统": "CONTEXT_MISSING", "一台dr": "IN", "DRY": "NO_TERM", "": "NO_TERM"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in df.select("want", matching.scope(F.col("t"), F.lit(""), terms).alias("got")).collect())
    rows = spark.createDataFrame([(1, "A CT scanner"), (2, "actor")], "i int, t string")
    words = spark.createDataFrame([("ct",), ("scan",)], "w string")
    assert {(r.i, r.w) for r in matching.keyword_matches(rows, "t", words, "w").collect()} == {(1, "ct"), (1, "scan")}


def test_ledger(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 5, 9, 10, 25)], "k string, at long")
    got = [(r.at, r.window_start, r.hits, r.limited) for r in ledger.first_hit_windows(df, "k", "at", 10, 2).orderBy("at").collect()]
    assert got == [(0, 0, 1, False), (5, 0, 2, False), (9, 0, 3, True), (10, 10, 1, False), (25, 25, 1, False)]
    staged = spark.createDataFrame([("a", 1, "OK"), ("a", 2, "FAILED"), ("b", 3, "OK")], "s string, i int, status string")
    assert [r.i for r in ledger.released(staged, "s", F.col("status") == "FAILED").collect()] == [3]
    assert ledger.pruned(df, F.lit(20), "at").count() == 4


def test_validation(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, " ", 5), (3, "x", None)], "i int, t string, n int")
    good, bad = validate.quarantined(df, [("TEXT", validate.filled(F.col("t"), "string")), ("N", F.col("n") > 0)])
    assert [r.i for r in good.collect()] == [1] and {r.i: r.error_code for r in bad.collect()} == {2: "TEXT", 3: "N"}
    missing = validate.unsupported({"facts.a": F.lit(True), "facts.b": F.lit(True), "facts.c": F.lit(False)}, F.array(F.struct(F.lit("facts.a").alias("field_path"))))
    assert one(spark, m=missing).m == ["facts.b"]
    assert tuple(one(spark, a=validate.whole_list(F.array(F.lit("a"), F.lit("a")), lambda x: x != ""), b=validate.whole_list(F.array(F.lit("a")), lambda x: x != ""))) == (False, True)
    none = spark.createDataFrame([], "id int, g string")
    assert tuple(analytics.discovery_metrics(none, none.select("id"), "id", "g").select("recall", "grounding", "format_valid", "score").first()) == (None, 1.0, 1.0, None)
    outputs = spark.createDataFrame([(1, None), (1, None), (2, None), (3, "UNGROUNDED"), (4, "INVALID")], "id int, g string")
    m = analytics.discovery_metrics(outputs, spark.createDataFrame([(1,), (9,)], "id int"), "id", "g").first()
    assert (m.candidates, m.hits, m.novel, m.recall, m.grounding, m.format_valid, m.score) == (2, 1, 1, 0.5, 0.8, 0.6, 56.5)


def test_merged_rows_move_once(spark, monkeypatch):
    """Whole rows are joined with few linked numbers by broadcast; many linked ones are shuffled, with the same result."""
    rows = [("m", i, f"i{i * 7 % 60}" if i % 5 else None, f"n{i * 11 % 90}" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "market string, seq int, id string, number string")
    merged = lambda: merge.merge_by_two_keys(df, "market", "seq", "id", "number")
    few = merged()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and plan.count("RepartitionByExpression") == 1
    alone = lambda x, i: x or f"null {i}"  # noqa: E731  NULL matches nothing
    want = plain_merge([(i, alone(name, i), alone(number, i)) for _, i, name, number in rows])
    assert sorted((r.seq, alone(r.id, r.seq), alone(r.number, r.seq)) for r in few.collect()) == want
    monkeypatch.setattr(merge, "BROADCAST_ROWS", 0)
    assert sorted((r.seq, alone(r.id, r.seq), alone(r.number, r.seq)) for r in merged().collect()) == want
