"""Invented notices, and scans that go on."""

from pyspark.sql import functions as F

from sievegrid.functions import notices
from sievegrid.operators import continuation

TENDER = """项目编号：TJ-2024-001 项目名称：监护仪采购项目 采购人名称：甲医院 公告时间：2024年03月01日 预算金额：125.5万元
二、获取招标文件 时间：2024年3月2日至2024年3月8日，每天上午 9:00 至 11:30，下午 13:00 至 17:00 地点：线上
三、提交投标文件截止时间：2024年3月20日 24:00 项目联系人：Contact A 联系电话：000-0000000"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tender(spark):
    x = one(spark, notices.tender_facts(F.lit(TENDER)))
    assert (x.project_number, x.project_name, x.buyer_name, x.published_at, x.budget_cny, x.error_code) == ("TJ-2024-001", "监护仪采购项目", "甲医院", "2024-03-01", 1_255_000, None)
    assert (x.registration_deadline, x.bid_deadline) == ("2024-03-08T17:00:00+08:00", "2024-03-21T00:00:00+08:00")
    assert tuple(x.public_contact) == ("Contact A", "项目联系人", "000-0000000", None)
    assert one(spark, notices.tender_facts(F.lit(""))).error_code == "PROJECT_NUMBER_NOT_FOUND"
    assert one(spark, notices.tender_facts(F.lit(None).cast("string"))).error_code == "PROJECT_NUMBER_NOT_FOUND"
    assert one(spark, notices.moment(F.lit("2024年2月30日 10:00"))) is None


def correction(change, number="原公告的采购项目编号：XC-2026-1"):
    return f"更正公告\n一、项目基本情况\n{number}\n原公告的采购项目名称：微生物 设备购置\n首次公告日期：2026-08-24\n二、更正信息\n更正事项：采购公告\n更正内容：{change}\n更正日期：2026-09-01\n三、其他补充事宜 无"


BID, REGISTRATION = "facts.bid_deadline", "facts.registration_deadline"
#: What a correction says, its overrides, its changed paths, and what stays open.
CORRECTIONS = [
    ("原公告的投标文件提交截止时间：2026-09-14 09:30:00，更正为：2026-09-18 09:30:00。", {BID: "2026-09-18T09:30:00+08:00"}, [BID], []),
    ("原公告的响应文件提交截止时间：2026-05-26 08:30:00，更正为：2026-05-29 08:30:00。", {BID: "2026-05-29T08:30:00+08:00"}, [BID], []),
    ("原公告的获取招标文件结束日期：2026-08-31，更正为：2026-09-04。\n原公告的投标文件提交截止时间：2026-09-14 09:30，更正为：2026-09-20 09：30。", {BID: "2026-09-20T09:30:00+08:00"}, [BID, REGISTRATION], [REGISTRATION]),
    ("原公告的获取采购文件结束时间：2026-08-31 17:00，更正为：2026年9月4日 17时30分。", {REGISTRATION: "2026-09-04T17:30:00+08:00"}, [REGISTRATION], []),
    ("原公告的投标文件提交截止时间：2026-09-14 09:30:00，更正为：2026-09-18 09:30:00。同时调整采购需求中的技术参数", {BID: "2026-09-18T09:30:00+08:00"}, [BID], ["__material_correction__"]),
    ("投标截止时间另行通知，予以变更", {}, [BID], [BID]),
    ("联系人有误", {}, [], ["__unparsed_correction__"]),
    ("其他文字有误", {}, [], ["__unparsed_correction__"]),
    ("现更正投标截止时间、开标时间：2026年9月18日9时30分", {}, [BID], [BID]),
]


def test_corrections(spark):
    df = spark.createDataFrame([(i, correction(c[0])) for i, c in enumerate(CORRECTIONS)], "i int, t string")
    for r in df.select("i", notices.event_facts(F.col("t")).alias("x")).collect():
        _, overrides, changed, left = CORRECTIONS[r.i]
        x = r.x
        assert (x.event_type, x.project_number, x.project_name, x.published_at, x.terminal, x.error_code) == ("CORRECTION", "XC-2026-1", "微生物 设备购置", "2026-09-01", False, None)
        assert (x.fact_overrides, x.changed_fact_paths, x.unresolved_fact_paths, x.requires_reconciliation) == (overrides, changed, left, bool(left)), r.i


def test_events(spark):
    # A heading outside the summary does not make it material; a summary needs its end.
    outside = one(spark, notices.event_facts(F.lit("采购需求 更正公告 项目编号：T 更正日期：2026年9月1日 二、更正信息 联系人有误 三、其他补充事项")))
    assert (outside.unresolved_fact_paths, outside.summary, outside.published_at) == (["__unparsed_correction__"], "联系人有误", "2026-09-01")
    untitled = one(spark, notices.event_facts(F.lit("二、更正信息 采购项目编号：T2 发布日期：2026年9月1日 原公告的响应文件提交截止时间：2026-05-26 08:30 更正为：2026-05-29 08:30")))
    assert (untitled.event_type, untitled.project_number, untitled.fact_overrides, untitled.summary) == ("CORRECTION", "T2", {BID: "2026-05-29T08:30:00+08:00"}, None)
    ended = one(spark, notices.event_facts(F.lit("终止公告\n发布日期：2026年08月25日\n采购项目编号：XC-2\n采购项目名称：设备购置\n二、项目终止的原因：无供应商投标\n三、其他补充事宜：无")))
    assert (ended.event_type, ended.terminal, ended.published_at, ended.summary, ended.project_name, ended.unresolved_fact_paths, ended.fact_overrides, ended.requires_reconciliation) == ("TERMINATION", True, "2026-08-25", "无供应商投标", "设备购置", [], {}, False)
    assert [one(spark, notices.event_facts(F.lit(t))).error_code for t in ("?", "终止公告", "终止公告 项目编号：1")] == ["EVENT_TYPE_NOT_FOUND", "PROJECT_NUMBER_NOT_FOUND", "PUBLISHED_DATE_NOT_FOUND"]
    assert one(spark, notices.event_facts(F.lit(None).cast("string"))).error_code == "EVENT_TYPE_NOT_FOUND"
    w = one(spark, notices.fallback_event(notices.event_facts(F.lit("?")), F.lit("TJ-3"), F.lit("CORRECTION"), F.lit("2024-01-01")))
    assert w.unresolved_fact_paths == ["__unparsed_correction__"] and w.fact_overrides == {}


def test_search_row(spark):
    rows = {
        "2024.01.05 | 采购人:甲医院 | 代理机构 | 公开招标 | 其他 | 北京": ("2024-01-05", "甲医院", "北京", "公开招标"),
        "2024/1/5 10:00:00 | 采购人：甲医院 | 代理机构：乙 | 公开招标公告 | 天津市河西区": ("2024-01-05", "甲医院", "天津市河西区", "公开招标公告"),
        "行政区域：吉林 竞争性谈判公告 | 采购人：": (None, None, "吉林", "竞争性谈判公告"),
        "位于北京的医院 | 上海 | 天津市，河西区 | 北京市某医院": (None, None, None, None),
        "地域:上海 | 河北省雄安新区 | 2024-01-05": ("2024-01-05", None, "河北省雄安新区", None),
        "": (None, None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: tuple(r.x) for r in df.select("t", notices.search_metadata(F.col("t")).alias("x")).collect()} == rows


def test_segments(spark):
    rows = [("r", 0, ["a", "b"], False, "p2"), ("r", 1, ["c"], False, "p3"), ("r", 2, ["a"], True, None), ("s", 1, ["x"], True, None), ("t", 0, ["y"], True, "p9")]
    df = spark.createDataFrame(rows, "root string, i int, anchors array<string>, done boolean, resume string").withColumn("mark", F.sha2(F.concat_ws("\n", "anchors"), 256))
    df = df.unionByName(df.where("root = 's'").withColumns({"root": F.lit("u"), "i": F.lit(0), "mark": F.lit("?")}))
    got = continuation.segment_faults(df, "root", "i", "anchors", "mark", F.sha2(F.concat_ws("\n", "anchors"), 256), "done", "resume")
    assert {(r.root, r.i): r.fault for r in got.collect()} == {("r", 0): None, ("r", 1): None, ("r", 2): "ANCHOR_SEEN", ("s", 1): "INDEX", ("t", 0): "RESUME", ("u", 0): "FINGERPRINT"}


def test_unseen_and_findings(spark):
    anchors = spark.createDataFrame([("s", f"u{p}{i}", p, i) for p in range(5) for i in range(4)], "source string, url string, page int, place int")
    seen = spark.createDataFrame([("s", "u00")], "source string, url string")
    got, left = continuation.unseen(anchors, seen, "source", "url", "page", "place", room=9, pages=3)
    assert got.count() == 9 and [tuple(r) for r in left.collect()] == [("s", 2)]
    ledger = spark.createDataFrame([("a", 1, 5, 2, True), ("b", 1, 5, 2, False)], "k string, first_seen int, last_seen int, times_seen int, active boolean")
    found = spark.createDataFrame([("b", 9), ("c", 9), ("c", 9)], "k string, seen int")
    merged = {r.k: tuple(r)[1:] for r in continuation.merged_findings(ledger, found, ["k"]).collect()}
    assert merged == {"a": (1, 5, 2, True), "b": (1, 9, 3, True), "c": (9, 9, 1, True)}
    assert [one(spark, continuation.publish_gate(*map(F.lit, x))) for x in ((0, 0, 0), (1, 2, 0), (1, 0, 0))] == ["NO_SEARCH_SUCCEEDED", "NOTHING_VERIFIED", None]
    ids = continuation.prewarm_ids(spark.createDataFrame([("x", 1)], "id string, rank int"), spark.createDataFrame([("x", 9), ("y", 5), ("z", 7)], "id string, score int"), "id", "rank", "score", F.col("id") != "q", 2)
    assert [r.id for r in ids.collect()] == ["x", "z"]


def test_parsing_tasks_are_of_bounded_rows(spark, tmp_path):
    """One file of many rows is dealt into tasks that do not grow with it; no row is lost."""
    from pyspark.sql import functions as F

    from sievegrid.plans import notices as plan

    spark.range(400_000).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    sizes = [r["count"] for r in plan._rows(spark, str(tmp_path), "orders").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= plan.TASK_ROWS * 1.05
