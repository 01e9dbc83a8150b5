"""Articles and index pages of single sites, written in their layouts with invented values."""

import pytest

from sievegrid.operators import sites

DAY = "2026-09-03"
PAGES = {
    "teda": (
        "https://www.tedahospital.com.cn/article/show/9/77", "院内设备需求调研公告",
        "<h2>院内设备需求调研公告</h2><p>开展医疗设备采购需求调研。</p><p>一、拟采购设备项目：</p><p>1、设备明细：</p><p>1）超声诊断仪（彩色 3 台套）2台 预算：30.5万元；</p><p>2） 监护仪 预算 500元</p><p>2、其他需求：无</p><p>二、报名资料</p>"
        "<p>报名截止时间：2026年9月1<span> 0 </span>日下午5:30</p><p>联系方式：甲老师：022-1234567 a.b@c.example 医疗设备部</p><p>天津市泰达医院 2026年9月3日</p>",
    ),
    "tjmugh": (
        "https://www.tjmugh.com.cn/system/2026/09/03/100.shtml", "医疗设备市场调研",
        "<title>x</title><p>天津医科大学总医院 天津医科大学总医院医疗设备市场调研论证邀请函</p><p>2026-09-03 来源</p><p>一、论证项目名称：（1）呼吸机；（2） 输液泵</p><p>二、供应商资格</p><p>本次报名截止时间为2026年9月10日 17:0<b>0</b></p><p>联系电话：0221234567 乙老师</p>",
    ),
    "tjnothop": (
        "https://www.tjnothop.cn/system/2026/09/03/101.shtml", "天津市天津医院手术床采购项目调研公告",
        "<h1>天津市天津医院 手术床采购项目调研公告</h1><p>一、产品要求 1、产品名称：手术床 2、采购数量：3台 3、预算金额：12.5万元</p><p>四、报名及资质提交时间：2026年9月4日至2026年9月8日</p><p>五、论证时间</p><p>联系人：丙 联系电话：022-7654321 设备物资科</p>",
    ),
    "tjfch": (
        "https://www.tjfch.com.cn/system/2026/09/03/102.shtml", "内镜清洗机院内比...",
        "<title>网站</title><h1>内镜清洗机院内比选采购公告</h1><p>发布 2026-09-03 10:00</p><p>项目编号：AB－12 最高限价：1,200,000元</p><p>响应文件递交截止时间：2026年9月12日 下午 2:30</p><p>联系人：丁 联系电话：022 - 12345678</p>",
    ),
    "tjfch_test": (
        "https://www.tjfch.com.cn/system/2026/09/03/103.shtml", "输液泵测试企业征集公告",
        "<p>1999-01-01</p><h1>输液泵测试企业征集公告</h1><p>2026-09-03 08:00</p><p>报名自公告发布之日起7天，逾期无效</p><p>咨询电话：022-1234 5678 邮箱 x@y.example</p>",
    ),
    "tjzxfc": (
        "https://www.tjzxfc.cn/system/2026/09/03/104.shtml", "天津市中心妇产科医院采血管采购项目市场调研公告",
        "<p>天津市中心妇产科医院采血管采购项目市场调研公告</p><p>来源： 设备科 时间：2026-09-03</p><table><tr><td>序号</td><td>名称</td></tr><tr><td>1</td><td>监护仪</td></tr><tr><td>2</td><td>监护仪</td></tr></table><p>提交时间截至2026年9月9日</p><p>设备科电话：022-12345678</p>",
    ),
    "tjzyefy": (
        "https://www.tjzyefy.com/system/2026/09/03/105.shtml", "医用设备调研公告",
        "<p>天津中医药大学第二附属医院</p><h1>医用设备调研公告</h1><p>2026-09-03</p><p>项目背景与目标</p><p>三、核心需求清单 1. 输液泵（移动）：功率 1.5kW； 2. 监护仪: 床旁用</p><p>四、资质</p><p>方案报送截止：2026年9月5日至2026年9月8日 16:00</p><p>技术咨询：022-12345678 戊老师 发送邮箱：q@w.example</p>",
    ),
    "tjzyefy_intent": (
        "https://www.tjzyefy.com/system/2026/09/03/106.shtml", "采购意向公告-灭菌器等设备采购项目",
        "<p>天津中医药大学第二附属医院 采购意向公告-灭菌器等设备采购项目</p><p>2026-09-03</p><p>我院将于近期对脉动灭菌器、内镜等设备采购项目进行采购，欢迎供应商咨询。预计采购时间为2026年 9-10 月。</p><p>本项目具体招标信息请于近期关注：天津市政采网、cebpubservice.com。联系人：己 联系电话：022-12345678</p>",
    ),
}


def articles(spark, rows):
    return spark.createDataFrame(rows, "site string, url string, html string, index_url string, published_at string, title string, extra int")


def row(site, **other):
    url, title, html = PAGES[site]
    one = {"site": site, "url": url, "html": html, "index_url": url, "published_at": DAY, "title": title, "extra": 1} | other
    return tuple(one.values())


@pytest.fixture(scope="module")
def read(spark):
    rows = sites.site_records(articles(spark, [row(s) for s in PAGES])).collect()
    return {r.site: r for r in rows}


def test_all_sites_give_records(read):
    assert {s: r.error_code for s, r in read.items()} == dict.fromkeys(PAGES)
    for s, r in read.items():
        assert r.facts.published_at == DAY and r.extra == 1
        filled = {f"facts.{k}" for k, v in r.facts.asDict().items() if v not in (None, [])}
        assert filled == {e.field_path for e in r.evidence}, s
    assert read["teda"].source_id == "teda:teda_77"
    assert read["tjfch_test"].source_id == "tjfch-test:tjfch_20260903_103"


def test_facts(read):
    f = {s: r.facts for s, r in read.items()}
    shown = lambda s: [(i.raw_name, i.quantity, i.specification) for i in f[s].product_items]
    assert shown("teda") == [("超声诊断仪", "2台", "彩色 3 台套"), ("监护仪", None, None)]
    assert f["teda"].budget_cny == 305500 and f["teda"].registration_deadline == "2026-09-10T17:30:00+08:00"
    assert tuple(f["teda"].public_contact) == ("甲老师", "医疗设备部", "022-1234567", "a.b@c.example")
    assert shown("tjmugh") == [("呼吸机", None, None), ("输液泵", None, None)]
    assert f["tjmugh"].project_name == "天津医科大学总医院医疗设备市场调研论证邀请函" and f["tjmugh"].registration_deadline == "2026-09-10T17:00:00+08:00"
    assert tuple(f["tjmugh"].public_contact) == ("乙老师", "设备采购科", "0221234567", None)
    assert shown("tjnothop") == [("手术床", "3台", None)] and f["tjnothop"].budget_cny == 125000 and f["tjnothop"].registration_deadline_date == "2026-09-08"
    assert read["tjnothop"].quality_flags == [sites.NO_TIME]
    assert f["tjfch"].project_name == "内镜清洗机院内比选采购公告" and f["tjfch"].project_number == "AB-12" and f["tjfch"].budget_cny == 1200000
    assert f["tjfch"].bid_deadline == "2026-09-12T14:30:00+08:00" and f["tjfch"].public_contact.phone == "022-12345678" and f["tjfch"].registration_deadline is None
    assert read["tjfch_test"].quality_flags == [sites.SEVEN_DAYS] and f["tjfch_test"].public_contact.phone == "022-12345678"
    assert shown("tjzxfc") == [("采血管", None, None), ("监护仪", None, None)] and f["tjzxfc"].product_items[0].category == "采血" and f["tjzxfc"].department == "设备科"
    assert f["tjzxfc"].registration_deadline_date == "2026-09-09"
    assert shown("tjzyefy") == [("输液泵", None, "功率 1.5kW"), ("监护仪", None, "床旁用")] and f["tjzyefy"].notice_type == "调研公告"
    assert f["tjzyefy"].registration_deadline == "2026-09-08T16:00:00+08:00" and f["tjzyefy"].public_contact.name == "戊老师"
    assert shown("tjzyefy_intent") == [("脉动灭菌器", None, None), ("内镜", None, None)]
    assert read["tjzyefy_intent"].quality_flags == [sites.WINDOW, sites.WINDOW_TEXT + "2026年9-10月", sites.FOLLOW + "CEB_PUBLIC_SERVICE", sites.FOLLOW + "TIANJIN_GPC"]


def changed(site, old, new):
    return row(site, html=PAGES[site][2].replace(old, new))


def test_errors(spark):
    cases = [
        (row("teda", published_at="2026-09-04"), "TEDA_PUBLISHED_DATE_MISMATCH"),
        (row("teda", title="别的公告"), "TEDA_TITLE_MISMATCH"),
        (row("teda", url="https://www.tedahospital.com.cn/article/show/8/77"), "TEDA_SOURCE_URL_REJECTED"),
        (changed("teda", "30.5万元", "30.55555万元"), "TEDA_BUDGET_INVALID"),
        (changed("teda", "下午5:30", "下午5:70"), "TEDA_REGISTRATION_DEADLINE_INVALID"),
        (changed("teda", "天津市泰达医院 2026年9月3日", "天津市泰达医院 2026年13月3日"), "TEDA_PUBLISHED_DATE_INVALID"),
        (changed("tjmugh", "二、供应商", ""), "TJMUGH_PROJECT_SECTION_NOT_FOUND"),
        (changed("tjmugh", "报名截止", "截止"), "TJMUGH_REGISTRATION_DEADLINE_NOT_FOUND"),
        (row("tjnothop", index_url="https://tjnothop.cn/"), "TJNOTHOP_INDEX_DETAIL_HOST_MISMATCH"),
        (changed("tjnothop", "12.5万元", "12.55555万元"), "TJNOTHOP_BUDGET_NOT_WHOLE_CNY"),
        (row("tjfch", title="内镜清洗机采购..."), "TJFCH_TITLE_MISMATCH"),
        (changed("tjfch", "2026-09-03 10:00", "2026-09-05"), "TJFCH_DETAIL_PUBLISHED_DATE_NOT_CONFIRMED"),
        (changed("tjfch", "下午 2:30", ""), "TJFCH_BID_DEADLINE_NOT_EXACT"),
        (changed("tjfch", "比选采购公告", "比选采购结果公告"), "TJFCH_NOTICE_TYPE_UNSUPPORTED"),
        (changed("tjfch_test", "逾期无效", ""), "TJFCH_TEST_REGISTRATION_WINDOW_UNSUPPORTED"),
        (row("tjzxfc", published_at="2026-09-02"), "TJZXFC_PUBLISHED_DATE_MISMATCH"),
        (changed("tjzxfc", "提交时间截至", ""), "TJZXFC_REGISTRATION_DEADLINE_NOT_FOUND"),
        (row("tjzyefy", title="采购意向公告", html="<p>天津中医药大学第二附属医院 采购意向公告</p>"), "TJZYEFY_PROCUREMENT_INTENT_NOT_SUPPORTED"),
        (changed("tjzyefy", "方案报送截止：2026年9月5日至2026年9月8日", "方案报送截止：另行"), "TJZYEFY_REGISTRATION_DATE_NOT_FOUND"),
        (changed("tjzyefy", "16:00", "26:00"), "TJZYEFY_REGISTRATION_TIME_INVALID"),
        (changed("tjzyefy_intent", "欢迎", ""), "TJZYEFY_INTENT_SUPPLIER_CONSULTATION_NOT_FOUND"),
        (row("tjzyefy_intent", html=None), "TJZYEFY_INTENT_HOSPITAL_IDENTITY_NOT_FOUND"),
        (("nowhere", None, None, None, None, None, 0), "SITE_UNKNOWN"),
    ]
    got = sites.site_records(articles(spark, [c for c, _ in cases])).collect()
    assert [(r.site, r.error_code) for r in got] == [(c[0], code) for c, code in cases]
    assert all(r.facts is None and r.evidence is None for r in got)


def test_index_pages(spark):
    link = lambda href, title, tail="": f"<li><a class=x href='{href}'>{title}</a><i>{tail}</i></li>"
    pages = [
        ("teda", "https://www.tedahospital.com.cn/article/plist/9", link("/article/show/9/5#x", "甲 设备需求调研", "2026.9.2") + link("/article/show/9/5", "乙设备需求调研") + link("http://tedahospital.com.cn/article/show/9/6", "论证邀请公告") + link("/article/show/9/7", "设备需求调研结果")),
        ("tjnothop", "https://www.tjnothop.cn/xwzx/index.shtml", link("/system/2026/09/01/1.shtml", "天津市天津医院床采购项目调研公告", "2026-09-01") + link("/system/2026/09/02/2.shtml", "天津市天津医院灯采购项目调研公告", "2026-09-02") + link("http://www.tjnothop.cn/system/2026/09/02/3.shtml", "天津市天津医院灯采购项目调研公告")),
        ("tjfch", "https://www.tjfch.com.cn/ywgk/ynbx/index.shtml", link("/system/2026/09/01/1.shtml", "灯院内比选采…") + link("/system/2026/09/02/2.shtml", "灯院内比选结…") + link("/system/2026/13/02/3.shtml", "灯院内比选公告") + link("/system/2026/09/03/4.shtml", "灯院内比选公告")),
        ("tjzyefy", "https://www.tjzyefy.com/xwgg/ggtz/", link("/system/2026/09/01/1.shtml", "监护仪调研公告") + link("/system/2026/09/02/2.shtml", "食堂调研公告") + link("/x/system/2026/09/02/2.shtml", "监护仪调研公告")),
        ("teda", "https://other.example/", link("/article/show/9/5", "设备需求调研")),
        ("teda", "https://tedahospital.com.cn/", None),
    ]
    found = sites.index_candidates(spark.createDataFrame(pages, "site string, url string, html string"))
    got = [(r.opportunity_id, r.published_at, r.url) for r in found.orderBy("index_url", "place").collect()]
    assert got == [
        ("teda_5", "2026-09-02", "https://www.tedahospital.com.cn/article/show/9/5"), ("teda_6", None, "https://tedahospital.com.cn/article/show/9/6"),
        ("tjfch_20260903_4", "2026-09-03", "https://www.tjfch.com.cn/system/2026/09/03/4.shtml"), ("tjfch_20260901_1", "2026-09-01", "https://www.tjfch.com.cn/system/2026/09/01/1.shtml"),
        ("tjnothop_20260902_2", "2026-09-02", "https://www.tjnothop.cn/system/2026/09/02/2.shtml"), ("tjnothop_20260901_1", "2026-09-01", "https://www.tjnothop.cn/system/2026/09/01/1.shtml"),
        ("tjzyefy_20260901_1", "2026-09-01", "https://www.tjzyefy.com/system/2026/09/01/1.shtml"),
    ]
    assert [r.opportunity_id for r in sites.since(found, "2026-09-01", "2026-09-03", 1).orderBy("index_url").collect()] == ["teda_5", "tjfch_20260903_4", "tjnothop_20260902_2", "tjzyefy_20260901_1"]
