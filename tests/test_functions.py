"""Single functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text, times
from sievegrid.operators import analytics, cards, ledger, matching, merge, profile, scoring, validate
from sievegrid.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, rows, schema, column):
    """The column's value for each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r.x for r in df.select("_i", column.alias("x")).orderBy("_i").collect()]


def test_cards(spark):
    rows = [(1, "BEFORE", False, 5), (2, "AFTER", False, 1), (3, "ACTIVE", True, 1), (4, None, False, 9), (5, "AFTER", False, 2)]
    df = spark.createDataFrame(rows, "i int, phase string, has boolean, at int")
    assert [r.i for r in df.orderBy(*cards.intent_order(F.col("has"), F.col("phase"), F.col("at"))).collect()] == [3, 5, 2, 1, 4]
    notices = spark.createDataFrame([("CCGP_NOTICE", True, " n1 ", None), ("CCGP_NOTICE", True, "n1", 9), ("CCGP_NOTICE", True, "n2", 5), ("CCGP_NOTICE", False, "n3", 9), ("OTHER", True, "n4", 9), ("CCGP_NOTICE", True, " ", 9)], "kind string, ok boolean, n string, d int")
    assert [r.project_number for r in cards.watch_list(notices, F.col("kind"), F.col("ok"), F.col("n"), F.col("d"), F.lit(5)).collect()] == ["n1"]
    assert values(spark, [(True, False, True), (None, True, False), (None, True, True), (False, False, None)], "h boolean, g boolean, s boolean", cards.recall_exclusion(F.col("h"), F.col("g"), F.col("s"))) == [True, True, False, False]
    assert values(spark, [("单一来源公告", None, True), ("x", "y", True), (None, None, None)], "t string, k string, e boolean", cards.skip_reason(F.col("t"), F.col("k"), F.col("e"))) == ["NON_COMPETITIVE_SINGLE_SOURCE", "OUT_OF_MEDICAL_SCOPE", None]
    days = spark.createDataFrame([(i,) for i in range(9)], "d int")
    assert [r.d for r in cards.date_window(days, F.col("d"), F.lit(2), F.lit(7), [F.desc("d")], 3).collect()] == [7, 6, 5]
    own = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, market string")
    records = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, at int, market string")
    assert {r.id: r.market for r in cards.with_market(own, records, "id", ["at"], ["market"]).collect()} == {"a": "y", "b": "old"}
    pairs = spark.createDataFrame([("i1", "f1"), ("i1", "f2")], "intent_key string, formal_key string")
    assert tuple(cards.intent_summary(spark.createDataFrame([(True,), (True,), (False,)], "i boolean"), pairs, F.col("i")).first()) == (2, 1, 2)
    intents = spark.createDataFrame([("a", 2, ["s1", "s2", "s1"], "k"), ("b", 9, ["s9"], None)], "id string, at int, s array<string>, k string")
    tasks = cards.directed_tasks(intents, "id", "at", F.col("s"), F.col("k"), ["s1"], 2).collect()
    assert [tuple(r) for r in tasks] == [("b", "s9", None, "UNSUPPORTED_SOURCE_ADAPTER"), ("a", "s1", "k", "READY")]
    keyword = lambda items, subject: one(spark, cards.search_keyword(F.array(*map(F.lit, items)).cast("array<string>"), F.lit(subject), ["设备"]))
    assert (keyword(["设备", " 生化 仪；"], "x"), keyword(["设备"], "采购意向公告（甲）- 病房 改造采购项目"), keyword([], "设备项目")) == ("生化仪", "病房改造", None)


def test_snapshots_and_changes(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    faults = lambda c, p, *n, **k: {r.fault for r in cards.snapshot_faults(ids(*c), ids(*p), "id", *n, **k).collect()}
    assert faults(["a"], ["a", "b"], 1, 2, 2) == set()
    assert faults(["a", "a", "z"], ["a", "b", "b"], 2, 2, 9, most_cards=2, most_pool=2) == {"CARDS_INVALID", "CARD_COUNT_MISMATCH", "DUPLICATE_TOP5_ID", "POOL_INVALID", "DUPLICATE_POOL_ID", "POOL_COUNT_MISMATCH", "MATCHED_COUNT_MISMATCH", "TOP5_NOT_IN_POOL"}
    id_ = "followup:" + "a1-" * 12
    rows = [("WON", id_, None, None), ("WON", id_, None, 5), ("NOT_FIT", id_, "PRICE", None), ("NOT_FIT", id_, None, None), ("OPEN", id_, "PRICE", None), ("OPEN", id_, " ", 5), ("?", id_, None, None), ("OPEN", "x", None, None), (None, None, None, None)]
    valid = cards.mutation_valid(*map(F.col, "smrd"), ["OPEN", "WON", "NOT_FIT"], ["PRICE"], ["WON", "NOT_FIT"])
    assert values(spark, rows, "s string, m string, r string, d int", valid) == [True, False, True, False, False, True, False, False, False]
    schema = spark.createDataFrame([], "a struct<user_id:int,b:array<struct<AI_note:string,ok:int>>>, ok int").schema
    assert cards.forbidden_paths(schema, ["user_id"], ["ai_"]) == ["$.a.user_id", "$.a.b[].AI_note"]
    events = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3), (None, 4), (None, 5)], "id string, n int")
    assert {r.n: r.fault for r in validate.duplicate_ids(events, "id", ["n"]).collect()} == {1: None, 2: "DUPLICATE_EVENT_ID", 3: None, 4: None, 5: None}
    keys = values(spark, [("TJ", " N1 ", "b", "p", "d"), ("TJ", None, " B ", "P", " d ")], "m string, n string, b string, p string, d string", validate.canonical_key(*map(F.col, "mnbpd")))
    assert [k[0] for k in keys] == ["project_number", "fallback"] and keys[0][-1] == "n1" and keys[1][2:] == ["b", "p", "d"]


def test_ledgers(spark):
    assert values(spark, [("VERIFIED", "m", "m"), ("VERIFIED", "n", "m"), ("FAILED", "m", "m"), (None, None, None)], "s string, f string, v string", ledger.unresolved(*map(F.col, "sfv"))) == [False, True, True, True]
    runs = spark.createDataFrame([(1, "a", "FAILED"), (2, "b", "FAILED"), (3, "a", "FAILED"), (4, "a", "SUCCEEDED"), (5, "a", "SUCCEEDED"), (6, "b", "SUCCEEDED"), (7, "?", "FAILED")], "n int, stage string, status string").withColumn("cycle", F.lit("c"))
    got = {r.n: r.fault for r in ledger.stage_faults(runs, "cycle", ["n"], "stage", "status", ["a", "b"]).collect()}
    assert got == {1: None, 2: "STAGE_OUT_OF_ORDER", 3: None, 4: "ATTEMPTS_EXHAUSTED", 5: "STAGE_ALREADY_DONE", 6: None, 7: "STAGE_UNKNOWN"}
    dealt = ledger.sliced(spark.createDataFrame([(i,) for i in range(20)], "i int"), ["i"], 3, 2)
    assert {r.i: r.slice for r in dealt.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    states = [("READY", 5), ("READY", 11), ("PENDING", 30), ("PENDING", 31), ("FAILED", 20), ("FAILED", 21), (None, 0)]
    assert values(spark, states, "s string, a int", ledger.cache_state(F.col("s"), F.col("a"), 10, 20, 30)) == ["USE", "REFRESH", "WAIT", "REFRESH", "WAIT", "REFRESH", "REFRESH"]
    assert values(spark, [(0,), (690,), (704,), (705,), (1125,), (1139,), (1140,)], "m int", ledger.next_tick(F.col("m"))) == [690, 705, 705, 720, 1140, 1140, None]


def test_merges(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "g string, k string, at int")
    merged = merge.capped_merge(rows(("g", "a", 5), ("g", "b", 1)), rows(("g", "a", 0), ("g", "c", 0), ("g", "d", 1), ("h", "a", 1)), ["k"], ["at"], "g", 3)
    assert sorted((r.g, r.k, r.at) for r in merged.collect()) == [("g", "a", 5), ("g", "b", 1), ("g", "c", 0), ("h", "a", 1)]
    followups, acks = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, r int"), spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), ("c", None)], "k string, r int")
    assert {r.k: r.r for r in merge.acknowledged(followups, acks, "k", "r").collect()} == {"a": None, "b": 2, "c": None}
    assert [r.k for r in merge.not_yet(followups, acks.where("k <> 'b'"), ["k"]).collect()] == ["b"]
    df = spark.createDataFrame([("m", "p"), ("n", "p")], "mark string, p string")
    assert [r.p for r in merge.payload_if_changed(df, F.lit("m"), "mark", "p").orderBy("mark").collect()] == [None, "p"]
    seen = merge.observation(F.lit('{"a":1}'), F.col("v"), F.col("k"), F.array(F.lit("http://x"), F.lit("https://Z.example/p"), F.lit("https://a.example/q")), F.lit("天津市"), F.lit("OPEN"))
    df = spark.createDataFrame([("VERIFIED", " id "), ("NO", "id"), ("VERIFIED", None)], "v string, k string")
    got = [r.x for r in df.select(seen.alias("x")).collect()]
    assert (got[0].opportunity_id, got[0].region_code, got[0].source_url, len(got[0].fact_hash)) == ("id", "CN-TJ", "https://Z.example/p", 64) and got[1:] == [None, None]


def test_analytics_and_scores(spark):
    events = spark.createDataFrame([("a", 1, "X"), ("a", 2, "?"), ("b", 1, "?")], "k string, at int, c string")
    code = F.when(F.col("c") != "?", F.col("c"))
    assert [tuple(r) for r in analytics.first_recognised(events, ["k"], ["at"], code).collect()] == [("a", "X")]
    parts = spark.createDataFrame([("r", 0, ["a"], False), ("r", 1, ["b", "c"], True)], "root string, i int, anchors array<string>, done boolean")
    assert [tuple(r) for r in analytics.continuation_summary(parts, "root", "i", F.col("anchors"), "done").collect()] == [("r", 2, 3, True)]
    assert values(spark, [(0, 3), (3, 0), (2, 2)], "z int, f int", analytics.health(F.col("z"), F.col("f"))) == ["FAILING", "SILENT", "HEALTHY"]
    assert values(spark, [(["P1"],), (["RELATIVE"],)], "f array<string>", times.relative_deadline(F.lit("2024-01-02 03:00:00").cast("timestamp"), F.col("f"), "RELATIVE").isNotNull()) == [False, True]
    points = scoring.specificity_points(F.lit(False), F.lit(True), F.col("c"), F.lit(True), F.lit(True), F.col("t"))
    assert values(spark, [(False, "CT 采购"), (True, "桌椅"), (None, None)], "c boolean, t string", points)[:2] == [8, 2]
    assert values(spark, [("设备租赁项目", None, None, False), ("设备", None, ["租赁服务"], True), ("设备", None, ["租赁服务"], False)], "t string, m string, c array<string>, x boolean", scoring.lease_wanted(*map(F.col, "tmcx"))) == [True, False, True]
    marks = values(spark, [([("u", "t"), ("v", "s")],), ([("v", "s"), ("u", "t")],), ([("u", "t")],)], "a array<struct<url:string,title:string>>", text.anchor_set_fingerprint(F.col("a")))
    assert marks[0] == marks[1] != marks[2] and len(marks[0]) == 32


def test_profiles(spark):
    found = spark.createDataFrame([("a", "KNOWN", 1), ("a", "KNOWN", 3), ("b", None, 1)], "k string, strength string, at int")
    best = {r.k: r.strength for r in profile.best_relationships(found, ["k"], "strength", "at").collect()}
    assert best == {"a": "KNOWN", "b": None}
    public = spark.createDataFrame([("c1", True), ("c2", False)], "id string, lease boolean")
    matches = spark.createDataFrame([("c1", "o", "RENTAL_CAPABLE"), ("c1", "o", "DIRECT")], "id string, owner string, kind string")
    relations = spark.createDataFrame([("c2", "o", "KNOWN")], "id string, owner string, strength string")
    wishes = spark.createDataFrame([("o", False, False, True)], "owner string, can_find_manufacturer boolean, can_partner_channel boolean, can_handle_lease boolean")
    got = {r.id: r for r in profile.private_context(public, "id", F.col("lease"), matches, relations, wishes, ["owner"], "kind", "strength").collect()}
    assert set(got) == {"c1", "c2"} and got["c1"].flexibility == 5 and got["c1"].capability > got["c2"].capability == 0
    assert one(spark, profile.searchable(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "a | b"
    assert values(spark, [("医疗设备",), ("桌",), (None,)], "t string", profile.broad_terms(F.col("t"), ["设备"])) == [True, False, False]
    words = spark.createDataFrame([("ab",), ("\U0001f600z",), ("",), (None,), ("aaaa",)], "w string")
    texts = spark.createDataFrame([(1, "xaby"), (2, "q\U0001f600zq"), (3, "aaa"), (4, None), (5, "b" * 300_000 + "aaaa")], "i int, t string")
    assert sorted((r.i, r.w) for r in profile.containing(texts, "t", words, "w").collect()) == [(1, "ab"), (2, "\U0001f600z"), (5, "aaaa")]
    assert profile.containing(texts, "t", words.where("false"), "w").count() == 0
    assert matching.known_status(spark.createDataFrame([(None,)], "u string"), "u", spark.createDataFrame([("k", [None])], "k string, us array<string>"), "k", "us").first().status == "NEW"


def test_sources(spark, tmp_path):
    shots = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("b", 2, "2024-01-01 00:00:00"), ("c", 9, "2024-01-01 01:00:00")], "source string, priority int, at string").withColumn("as_of", F.to_timestamp("at"))
    assert files.newest_source(shots, F.to_timestamp(F.lit("2024-01-01 00:30:00"))).first().source == "b"
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    found, national = spark.createDataFrame([("TJ",)], "m string"), spark.createDataFrame([("北京医院", 1), ("北京院", 2), ("天津", 3)], "label string, n int")
    markets = spark.createDataFrame([("TJ",), ("BJ",)], "m string")
    guess = F.when(F.startswith("label", F.lit("北京")), "BJ").when(F.startswith("label", F.lit("天津")), "TJ")
    assert [(r.m, r.n) for r in files.fallback_candidates(found, national, markets, "m", guess, [F.desc("n")], 1).collect()] == [("BJ", 2)]


@pytest.mark.parametrize("minute, want", [(689, 690), (1141, None)])
def test_ticks(spark, minute, want):
    assert one(spark, ledger.next_tick(F.lit(minute))) == want


def test_cards_meet_terms_before_owners(spark):
    """One row a card and group of terms is told apart, not one for each owner."""
    from sievegrid.plans import cards

    plan = cards.QUERIES["capability_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.split("\n") if "Aggregate [" in line and "p_partkey" in line]
    assert grouped and not any("owner" in line for line in grouped)
    # Owners of one keyword, a keyword by two of its group's terms, two spellings of one keyword.
    texts = spark.createDataFrame([(1, "CT机 计算机断层扫描 one"), (2, "act")], "id int, t string")
    own = spark.createDataFrame([("a", "ct", "k", 1), ("a", "CT", "k", 2), ("b", "ct", "k", 1), ("b", "ct", "k", 1), ("b", None, "k", 1)], "owner string, word string, kind string, at int")
    got = profile.capability_matches(texts, "id", F.col("t"), own, ["owner"], "word", "kind", "at", 12).collect()
    assert sorted((r.id, r.owner, r.word, r.place) for r in got) == [(1, "a", "CT", 1), (1, "a", "ct", 2), (1, "b", "ct", 1)]


def test_texts_are_scanned_as_bytes(spark, monkeypatch):
    """No array of characters is made; runs that cross steps and batches of the scan are found, each pair once."""
    import random

    monkeypatch.setattr(profile, "STEP_BYTES", 61)
    monkeypatch.setattr(profile, "OUT_BYTES", 97)
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("ab\0é中\U0001f600") for _ in range(n))
    texts = [(i, made(rng.randrange(90))) for i in range(300)] + [(300, None), (301, "")]
    words = sorted({made(rng.randrange(1, 7)) for _ in range(80)} | {texts[7][1], texts[8][1][3:30], "\0", "a\0", "a"} - {""})
    t, w = spark.createDataFrame(texts, "i int, t string").repartition(3), spark.createDataFrame([(x,) for x in [*words, "", None]], "w string")
    found = profile.containing(t, "t", w, "w")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.i, r.w) for r in found.collect()) == sorted((i, x) for i, said in texts for x in words if said and x in said)
