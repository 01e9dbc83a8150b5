"""Notices of single institutions: candidates from their index pages, records from their articles.

A site is a row of rules (``SITES``): hosts, paths, what its titles say, how its articles word dates,
products, budgets and contacts, and where each fact is proved. Rules are compiled to column
expressions; pages of all sites go through one scan, without a join, and each row pays for the
rules of its own site only. A page's texts and table rows are read once, in Arrow batches.

Whatever a page lacks, says twice in different ways, or says of something else ends in an error
code, the first by a fixed order for each site; such a row has no facts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.html import heading, links_with_tails, page_parts
from sievegrid.functions.notices import OFFSET
from sievegrid.functions.products import ITEM
from sievegrid.functions.text import absolute_url, any_term, collapse, let, official_url
from sievegrid.operators.matching import scope
from sievegrid.operators.validate import error_code, web_host

# Terms that tell medical notices from others.
SCOPE_TERMS = {
    "strong": [
        "医疗设备", "医疗器械", "医用", "诊断", "影像", "X线", "磁共振", "超声", "内镜", "内窥", "病理", "质谱", "液质联用", "液相色谱", "色谱", "流式细胞仪", "灭菌器", "测序", "采血", "试剂",
        "质控品", "校准品", "抗体", "抗原", "体外诊断", "基因", "微生物", "生化", "免疫", "血液", "透析", "放疗", "核医学", "麻醉", "监护", "呼吸机", "治疗仪", "输液", "手术器械", "康复设备",
        "胃肠动力", "心电", "脑电", "乳腺机", "眼底照相机", "疾病预防控制专用设备", "疾控专用设备",
    ],
    "contextual": ["检验", "检测", "实验室", "耗材", "信息互通共享", "应用支撑平台"],
    "adjacent": ["人工智能", "算力"],
    "context": ["医院", "医科大学", "医学科学院", "中医药", "疾病预防控制", "疾控", "卫生健康", "妇幼", "血站", "临床", "诊疗", "药品检验", "药检", "医疗卫生"],
    "hard": ["医用织物洗涤", "织物洗涤"],
    "generic": [
        "办公耗材", "办公用品", "安保服务", "保安服务", "物业服务", "保洁服务", "洗涤服务", "职工体检服务", "预包装食品", "班车", "业务用车租赁", "工服", "制服", "装修改造", "基建改造工程", "改造施工", "工程监理",
        "房屋修缮", "人才培养",
    ],
    "acronyms": ["CT", "DR", "MRI", "DSA", "PCR", "POCT", "IVD", "LIS", "PACS", "RIS", "HIS"],
    "adjacent_acronyms": ["GPU"],
}
# Flags of records.
NO_TIME, SEVEN_DAYS = "DEADLINE_TIME_NOT_PUBLISHED", "RELATIVE_REGISTRATION_WINDOW_7_DAYS"
WINDOW, WINDOW_TEXT, FOLLOW = "EXPECTED_PROCUREMENT_MONTH_WINDOW_UNSTRUCTURED", "EXPECTED_PROCUREMENT_MONTH_WINDOW_TEXT=", "OFFICIAL_FOLLOWUP_SOURCE="
FOLLOW_SOURCES = {"CEB_PUBLIC_SERVICE": ["中国招标投标公共服务平台", "cebpubservice.com"], "TIANJIN_GPC": ["天津市政采网", "天津市政采中心", "天津市政府采购中心", "tjgpc.zwfwb.tj.gov.cn", "tjgp.cz.tj.gov.cn"]}
RESULTS = ["结果", "成交", "中标", "废标", "终止", "更正", "变更", "公示"]

# How notices write dates, times, amounts and addresses.
_DAY = r"20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
_DAY_OPEN = _DAY + "?"
_DASHED = r"20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}"
_EITHER = r"20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?"
_CLOCK = r"\d{1,2}\s*[：:]\s*\d{2}"
_ALONE = r"(?<![\p{L}\p{N}_])(%s)(?![\p{L}\p{N}_])"
_MAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_YUAN = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(万元|万|元)"
_LINE = r"(0?\d{2,3}-?\d{7,8}|\d{7,12})"
_EDGES = " ：:;；,，"
_EDGES_STOP = "：:，,。；; "


class Page(NamedTuple):
    """An article: text, the same with digits joined that spaces part, and without any space; rows of tables; what its index said."""

    text: Column
    joined: Column
    bare: Column
    head: Column
    rows: Column
    title: Column
    bare_title: Column
    url: Column
    index_url: Column
    index_day: Column


class Site(NamedTuple):
    """Rules of one site. find: what a page says, by name; faults: codes and what must hold, in order; facts that are missing there are NULL."""

    ids: str
    prefix: str
    source: str
    hospital: str
    hosts: list[str]
    path: str
    wanted: Callable[[Column], Column]
    state: str
    locators: dict[str, str | Column | Callable[[Column], Column]]
    find: Callable[[Page], dict[str, Column]]
    faults: Callable[[Page, Column], list[tuple[str, Column]]]
    upgraded: bool = True  # plain http links count as https
    dated: str = "path"  # where an index states a day: in the path, or in the text after the link
    newest_first: bool = True
    flags: Callable[[Column], list[Column]] = lambda f: []
    one_host: bool = True  # index and article have the same host


def _said(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that gives something."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def _has(x: Column, *words: str) -> Column:
    return F.coalesce(x.rlike(any_term(list(words))), F.lit(False))


def _day(part: Column) -> Column:
    """yyyy-MM-dd of the last date in part, if the calendar has it."""
    n = lambda i: F.regexp_extract(part, r"(?s)^.*(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})", i).try_cast("int")
    return F.format_string("%04d-%02d-%02d", n(1), n(2), n(3)).try_cast("date").cast("string")


def _deadline(part: Column, clock: bool = True, halves: bool = False) -> Column:
    """struct(said, at, day) of the last date in part: a moment if a time of day follows, else a day. halves: mornings and afternoons count."""
    day = _day(part)
    if not clock:
        return F.struct(part.alias("said"), F.lit(None).cast("string").alias("at"), day.alias("day"))
    tail = F.regexp_extract(part, r"(?s)^.*20\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}\s*日?(.*)$", 1)
    number = lambda i: F.regexp_extract(tail, r"(\d{1,2})\s*[：:]\s*:?(\d{2})", i).try_cast("int")

    def of(n: Column) -> Column:
        hour = n["h"]
        if halves:
            hour = F.when(_has(n["t"], "下午") & (hour < 12), hour + 12).when(_has(n["t"], "上午") & (hour == 12), 0).otherwise(hour)
        at = F.when((n["h"] <= 23) & (n["m"] <= 59), F.concat(n["d"], F.format_string("T%02d:%02d:00", hour, n["m"]), F.lit(OFFSET)))
        return F.struct(n["p"].alias("said"), at.alias("at"), F.when(n["h"].isNull(), n["d"]).alias("day"))

    return let(F.struct(part.alias("p"), day.alias("d"), tail.alias("t"), number(1).alias("h"), number(2).alias("m")), of)


def _yuan(part: Column) -> Column:
    """Whole yuan of an amount; NULL if it has a fraction of one."""
    amount = F.regexp_replace(F.regexp_extract(part, _YUAN, 1), ",", "").try_cast("decimal(24,8)") * F.when(F.startswith(F.regexp_extract(part, _YUAN, 2), F.lit("万")), 10_000).otherwise(1)
    return let(amount, lambda v: F.when(v == F.floor(v), v.cast("long")))


def _pieces(text: Column, marker: str) -> Column:
    """What follows each marker, trimmed; nothing of what is before the first, and no empty ones."""
    parts = let(F.split(text, marker), lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ;；,，"))), lambda x: x != "")


def _item(name: Column, quantity: Column | None = None, specification: Column | None = None, category: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    return F.struct(name.alias("raw_name"), pick(category).alias("category"), pick(quantity).alias("quantity"), pick(specification).alias("specification"))


def _no_items() -> Column:
    return F.array().cast(ITEM)


def _first_of_name(items: Column) -> Column:
    """Items with a name, of each name the first."""
    named = F.filter(items, lambda i: i["raw_name"] != "")
    return let(named, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["raw_name"]), x["raw_name"]) == i + 1))


def _contact(name: Column, phone: Column, email: Column | None = None, title: Column | None = None, needs_number: bool = False) -> Column:
    """struct(name, title, phone, email), NULL if there is none of them, or without a number or address where one is needed."""
    none = F.lit(None).cast("string")
    email, title = none if email is None else email, none if title is None else title
    there = phone.isNotNull() | email.isNotNull()
    return F.when(there if needs_number else there | name.isNotNull(), F.struct(name.alias("name"), title.alias("title"), phone.alias("phone"), email.alias("email")))


def _word(text: Column, word: str) -> Column:
    return F.when(_has(text, word), F.lit(word))


def _in_scope(*parts: Column) -> Column:
    text = F.concat_ws("\n", *parts)
    return let(text, lambda t: scope(t, t, SCOPE_TERMS) == "IN")


def _names_of(items: Column, *fields: str) -> Column:
    return F.flatten(F.transform(items, lambda i: F.array(*[F.coalesce(i[f], F.lit("")) for f in fields])))


def _same_day(f: Column, p: Page) -> Column:
    return f["published_at"] == p.index_day


def _is_day(x: Column) -> Column:
    return x.rlike(r"^\d{4}-\d{2}-\d{2}$") & x.try_cast("date").isNotNull()


# Fixed values from here to SITES: the patterns by which each site words its facts, and the codes of faults with their order.

# ---- A: a research of needs; products in a numbered section, each with its own budget.


def _priced_item(part: Column) -> Column:
    """struct(i, b, priced) of a part such as 名称（规格）2台 预算：30万元: the item, its budget, and whether it states one."""
    price = r"预算\s*[：:]?\s*[0-9]+(?:\.[0-9]+)?\s*(?:万元|万|元)"
    before = F.regexp_extract(part, f"^(.*?)(?:{price}|$)", 1)
    # The first amount outside parentheses.
    counted = r"^([^（(]*?(?:[（(][^（）()]*[）)][^（(]*?)*?)([0-9]+(?:\.[0-9]+)?)\s*(台|套|个|批|件|组)"
    bound = F.struct(before.alias("b"), F.regexp_extract(before, counted, 2).alias("n"), F.nullif(F.regexp_extract(part, f"({price})", 1), F.lit("")).alias("p"))

    def of(x: Column) -> Column:
        front = F.when(x["n"] != "", F.regexp_extract(x["b"], counted, 1)).otherwise(x["b"])
        name = F.trim(F.regexp_replace(F.btrim(front, F.lit(_EDGES)), r"^设备明细\s*[：:]?\s*", ""))
        return let(name, lambda n: F.struct(split(n, F.when(x["n"] != "", F.concat(x["n"], F.regexp_extract(x["b"], counted, 3)))).alias("i"), _yuan(x["p"]).alias("b"), x["p"].isNotNull().alias("priced")))

    def split(name: Column, quantity: Column) -> Column:
        """A note in parentheses at the end is the specification."""
        noted = r"^(.+?)\s*[（(]\s*(.+?)\s*[）)]\s*$"
        part = lambda i: F.btrim(F.regexp_extract(name, noted, i), F.lit(_EDGES))
        both = (part(1) != "") & (part(2) != "")
        return _item(F.when(both, part(1)).otherwise(name), quantity, F.when(both, part(2)))

    return let(bound, of)


def _priced_parts(section: Column) -> Column:
    detail = F.trim(F.regexp_extract(section, r"(?:^|\s)1[、.．]\s*设备明细\s*[：:]?\s*(.+?)(?=(?:\s|^)2[、.．]\s*其他需求|$)", 1))
    nested = r"(?:^|\s)\d{1,2}\s*[）)]\s*"
    return F.when(detail != "", F.when(detail.rlike(nested), _pieces(detail, nested)).otherwise(F.array(detail))).otherwise(_pieces(section, r"(?:^|\s)\d{1,2}[、.．]\s*"))


def _teda(p: Page) -> dict[str, Column]:
    section = _said(p.text, r"一[、.．]\s*拟采购设备项目\s*[：:]?\s*(.+?)(?=\s*二[、.．]\s*报名资料)", r"拟采购设备项目\s*[：:]?\s*(.+?)(?=\s*二[、.．]\s*报名资料)")
    last = lambda date: F.try_element_at(F.regexp_extract_all(p.joined, F.lit(r"天津市泰达医院\s*(" + date + ")"), F.lit(1)), F.lit(-1))
    signed = F.coalesce(last(r"20\d{2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{1,2}"), last(_DAY))
    until = _said(p.joined, r"(报名截止时间\s*[：:]?\s*" + _DAY + r"(?:\s*(?:上午|下午)?\s*" + _CLOCK + ")?)")
    who = r"(?:联系方式\s*[：:]?\s*)?([一-鿿]{1,4}\s*老师)\s*[：:]?\s*([0-9-]{7,20})"
    return {
        "project_name": collapse(p.title),
        "section": section,
        "items": let(section, lambda s: F.transform(_priced_parts(s), _priced_item)),
        "signed": signed,
        "signed_day": _day(signed),
        "deadline": _deadline(until, halves=True),
        "notice_type": F.when(F.contains(p.bare_title, F.lit("需求调研")), "设备需求调研").otherwise("医疗设备论证邀请"),
        "public_contact": _contact(_bare(_said(p.joined, who)), F.nullif(F.regexp_extract(p.joined, who, 2), F.lit("")), _said(p.text, _MAIL), _word(p.text, "医疗设备部"), needs_number=True),
    }


def _teda_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    given = F.coalesce(p.index_day, F.lit("")) != ""
    return [
        ("TITLE_MISMATCH", (p.bare_title != "") & F.contains(p.bare, p.bare_title)),
        ("MEDICAL_EARLY_SIGNAL_NOT_VERIFIED", _has(p.bare, "医疗设备采购需求调研") | (_has(p.bare, "医疗设备采购") & _has(p.bare, "论证"))),
        ("PUBLISHED_DATE_INVALID", f["signed"].isNull() | f["signed_day"].isNotNull()),
        ("INDEX_PUBLISHED_DATE_INVALID", ~given | F.coalesce(_is_day(p.index_day), F.lit(False))),
        ("PUBLISHED_DATE_MISMATCH", f["signed"].isNull() | ~given | (f["signed_day"] == p.index_day)),
        ("OFFICIAL_PUBLISHED_DATE_NOT_AVAILABLE", f["signed"].isNotNull() | given),
        ("PRODUCT_SECTION_NOT_FOUND", f["section"].isNotNull()),
        ("PRODUCT_ITEMS_NOT_FOUND", F.size(f["items"]) > 0),
        ("PRODUCT_NAME_EMPTY", F.forall(f["items"], lambda x: ~x["i"]["raw_name"].isin("", "设备明细", "其他需求"))),
        ("BUDGET_INVALID", F.forall(f["items"], lambda x: ~x["priced"] | x["b"].isNotNull())),
        ("REGISTRATION_DEADLINE_NOT_FOUND", f["deadline"]["said"].isNotNull()),
        ("REGISTRATION_DEADLINE_INVALID", F.coalesce(f["deadline"]["at"], f["deadline"]["day"]).isNotNull()),
    ]


# ---- B: a research by an invitation; a numbered list of projects.


def _tjmugh(p: Page) -> dict[str, Column]:
    who = "天津医科大学总医院"
    own = _bare(_said(p.text, f"({who}[^。]{{0,80}}?市场调研论证邀请函)"))
    other = _bare(_said(p.text, r"([^。]{0,80}?医疗设备[^。]{0,40}?市场调研论证邀请函)"))
    title = F.coalesce(F.regexp_replace(own, f"^(?:{who})+(?={who})", ""), F.when(F.startswith(other, F.lit(who)), other).otherwise(F.concat(F.lit(who), other)))
    section = F.trim(_said(p.text, r"^.*?一[、.]\s*论证项目名称\s*[：:](.*?)二[、.]\s*供应商"))
    phone = r"联系电话\s*[：:]?\s*(\d{7,12})\s*([^\s，。；;]{1,8}老师)?"
    published = _said(p.text, _ALONE % _EITHER)
    return {
        "project_name": title,
        "published": published,
        "published_at": _day(published),
        "deadline": _deadline(_said(p.joined, r"(报名截止时间.{0,30}?" + _DAY_OPEN + r"[^0-9]{0,12}\d{1,2}\s*[：:]\s*:?\d{2})")),
        "section": section,
        "marked": section.rlike(r"[（(]\d{1,2}[）)]"),
        "product_items": F.transform(_pieces(section, r"[（(]\d{1,2}[）)]"), lambda n: _item(n)),
        "notice_type": F.lit("市场调研论证邀请函"),
        "public_contact": _contact(F.nullif(F.regexp_extract(p.joined, phone, 2), F.lit("")), _said(p.joined, phone), title=F.lit("设备采购科"), needs_number=True),
    }


def _tjmugh_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("TITLE_NOT_FOUND", f["project_name"].isNotNull()),
        ("PUBLISHED_DATE_NOT_FOUND", f["published"].isNotNull()),
        ("PUBLISHED_DATE_INVALID", f["published_at"].isNotNull()),
        ("REGISTRATION_DEADLINE_NOT_FOUND", f["deadline"]["said"].isNotNull()),
        ("REGISTRATION_DEADLINE_INVALID", f["deadline"]["at"].isNotNull()),
        ("PROJECT_SECTION_NOT_FOUND", f["section"].isNotNull()),
        ("PROJECT_ITEMS_NOT_FOUND", f["marked"]),
        ("PROJECT_ITEMS_EMPTY", F.size(f["product_items"]) > 0),
    ]


# ---- C: a research of one product; the deadline is the last day of a section.


def _tjnothop(p: Page) -> dict[str, Column]:
    trimmed = lambda x: F.btrim(x, F.lit(_EDGES))
    name = _said(p.text, r"产品名称\s*[：:]\s*(.+?)(?=\s+2[、.．])")
    section = _said(p.text, r"报名及资质提交时间\s*[：:]?\s*(.+?)(?=\s*(?:五|六)[、.．]\s*论证时间)")
    budget = _said(p.text, r"(预算金额\s*[：:]\s*[0-9]+(?:\.[0-9]+)?\s*(?:万元|元))")
    dated = F.when(section.rlike(_DAY_OPEN), section)
    return {
        "project_name": collapse(_said(p.text, r"(天津市天津医院\s*[^。]{1,100}?采购项目调研公告)")),
        "name": name,
        "product_items": F.array(_item(trimmed(name), F.nullif(trimmed(_said(p.text, r"采购数量\s*[：:]\s*(.+?)(?=\s+3[、.．])")), F.lit("")))),
        "budget": budget,
        "budget_cny": _yuan(budget),
        "section": section,
        "deadline": _deadline(dated, clock=False),
        "published_at": p.index_day,
        "notice_type": F.lit("采购项目调研公告"),
        "public_contact": _contact(_said(p.text, r"联系人\s*[：:]?\s*([^\s，。；;]{1,10})"), _said(p.text, r"联系电话\s*[：:]?\s*([0-9-]{7,20})"), title=_word(p.text, "设备物资科"), needs_number=True),
    }


def _tjnothop_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("INDEX_PUBLISHED_DATE_INVALID", _is_day(p.index_day)),
        ("TITLE_NOT_FOUND", f["project_name"].isNotNull()),
        ("TITLE_MISMATCH", _bare(f["project_name"]) == p.bare_title),
        ("PRODUCT_NAME_NOT_FOUND", f["name"].isNotNull()),
        ("PRODUCT_NAME_EMPTY", F.get(f["product_items"], F.lit(0))["raw_name"] != ""),
        ("BUDGET_NOT_WHOLE_CNY", f["budget"].isNull() | f["budget_cny"].isNotNull()),
        ("REGISTRATION_SECTION_NOT_FOUND", f["section"].isNotNull()),
        ("REGISTRATION_DATE_NOT_FOUND", f["deadline"]["said"].isNotNull()),
        ("REGISTRATION_DATE_INVALID", f["deadline"]["day"].isNotNull()),
    ]


# ---- D: a tender within the house; an index may cut the title, the article has it whole.


def _is_cut(title: Column) -> Column:
    return title.rlike(r"(?:\.{3}|…)$")


def _cut_off(title: Column) -> Column:
    return F.regexp_replace(title, r"(?:\.{3,}|…)+$", "")


def _selection_wanted(t: Column) -> Column:
    """A title of the kind, or one cut before it could say that it is none."""
    after = F.regexp_extract(_cut_off(t), r"^.*?院内比选(.*)$", 1)
    return _has(t, "院内比选") & ~_has(t, *RESULTS) & (_has(t, "公告") | (_is_cut(t) & ~after.rlike("^[结成中废终更变]")))


def _tjfch(p: Page) -> dict[str, Column]:
    head = p.head
    whole = F.when(_is_cut(p.bare_title), F.when(F.startswith(_bare(head), _cut_off(p.bare_title)), head)).when(_bare(head) == p.bare_title, head).when(F.contains(p.bare, p.bare_title), F.trim(p.title))
    day = p.index_day.try_cast("date")
    written = [p.index_day, F.date_format(day, "yyyy年MM月dd"), F.date_format(day, "yyyy年M月d日"), F.date_format(day, "yyyy 年 M 月 d 日")]
    confirmed = F.lit(False)
    for w in written:
        confirmed = confirmed | F.coalesce(F.contains(p.text, w), F.lit(False))
    handed = r"(?:递交|提交)[^。；;]{0,%d}?截止时间\s*[：:]?\s*"
    files = r"(?:院内比选响应文件|响应文件|投标文件|比选文件)[^。；;]{0,35}?"
    clocked = _DAY_OPEN + r"\s*(?:上午|下午)?\s*" + _CLOCK
    until = _said(p.text, "(" + files + handed % 20 + clocked + ")", "(" + handed % 35 + clocked + ")", "(" + handed % 35 + r"20\d{2}-\d{1,2}-\d{1,2}\s+" + _CLOCK + ")")
    amount = r"\s*[：:]\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:万元|元))"
    budget = _said(p.text, *[f"({label}{amount}" for label in ("项目预算", "最高限价", "预算金额")])
    phone = _said(p.text, r"(?:联系电话|电话)\s*[：:]\s*((?:1[3-9]\d{9})|(?:0\d{2,3}\s*[-－]\s*\d{7,8})|(?:0\d{9,11})|(?:\d{7,8}))")
    return {
        "project_name": whole,
        "confirmed": confirmed,
        "project_number": F.nullif(F.translate(_said(p.text, r"项目编号\s*[：:]\s*([A-Za-z0-9_\-－–—]+)"), "－–—", "---"), F.lit("")),
        "budget": budget,
        "budget_cny": _yuan(budget),
        "deadline": _deadline(until, halves=True),
        "published_at": p.index_day,
        "notice_type": F.lit("院内比选采购公告"),
        "procurement_method": F.lit("院内比选"),
        "public_contact": _contact(_said(p.text, r"联系人\s*[：:]\s*([^\s，,。；;]{1,15})"), F.replace(_bare(phone), F.lit("－"), F.lit("-")), _said(p.text, _MAIL)),
    }


def _tjfch_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    bare = _bare(f["project_name"])
    return [
        ("INDEX_PUBLISHED_DATE_INVALID", _is_day(p.index_day)),
        ("TITLE_MISMATCH", f["project_name"].isNotNull()),
        ("NOTICE_TYPE_UNSUPPORTED", _has(bare, "院内比选") & _has(bare, "公告") & ~_has(bare, *RESULTS)),
        ("DETAIL_PUBLISHED_DATE_NOT_CONFIRMED", f["confirmed"]),
        ("BUDGET_NOT_WHOLE_CNY", f["budget"].isNull() | f["budget_cny"].isNotNull()),
        ("BID_DEADLINE_NOT_EXACT", f["deadline"]["said"].isNotNull()),
        ("BID_DEADLINE_INVALID", f["deadline"]["at"].isNotNull()),
    ]


# ---- E: a call for tests; its window is seven days from publication, and no deadline is stated.


def _tjfch_test(p: Page) -> dict[str, Column]:
    title = collapse(p.title)
    at = F.instr(p.text, title)
    after = F.substring(F.when(at > 0, F.substring(p.text, at + F.length(title), F.lit(1 << 30))).otherwise(p.text), 1, 500)
    published = let(after, lambda x: _said(x, _ALONE % r"20\d{2}-\d{1,2}-\d{1,2}(?:\s+\d{1,2}:\d{2})?", f"({_DAY})"))
    phone = _bare(_said(p.text, r"(?:联系电话|咨询电话|电话)\s*[：:]\s*([0-9][0-9\-\s]{6,24})"))
    return {
        "project_name": F.trim(p.title),
        "published": published,
        "published_at": _day(published),
        "notice_type": F.lit("测试企业征集公告"),
        "public_contact": _contact(_said(p.text, r"联系人(?:姓名)?\s*[：:]\s*([^\s，,。；;]{1,15})"), phone, _said(p.text, _MAIL)),
    }


def _tjfch_test_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("TITLE_MISMATCH", F.contains(p.bare, p.bare_title)),
        ("NOTICE_TYPE_UNSUPPORTED", _has(p.bare_title, "测试企业征集公告")),
        ("PUBLISHED_DATE_NOT_FOUND", f["published"].isNotNull()),
        ("PUBLISHED_DATE_INVALID", f["published_at"].isNotNull()),
        ("REGISTRATION_WINDOW_UNSUPPORTED", _has(p.bare, "自公告发布之日起7天") & _has(p.bare, "逾期无效")),
    ]


# ---- F: a research with its products in tables or in the title.


def _tjzxfc(p: Page) -> dict[str, Column]:
    numbered = F.filter(p.rows, lambda r: (F.size(r) >= 2) & F.trim(F.get(r, F.lit(0))).rlike(r"^\d{1,3}$"))
    names = F.transform(numbered, lambda r: F.btrim(F.get(r, F.lit(1)), F.lit(_EDGES)))
    listed = F.transform(F.slice(F.array_distinct(F.filter(names, lambda n: (n != "") & (F.length(n) <= 120))), 1, 50), lambda n: _item(n))
    titled = F.btrim(_said(p.bare_title, r"(?:天津市中心妇产科医院)?(.{2,60}?)采购项目市场调研"), F.lit("：:，, "))
    kind = F.coalesce(*[_word(p.text, w) for w in ("病理", "检验", "影像", "超声", "内镜", "麻醉", "采血")])
    both = F.struct(listed.alias("l"), F.when(~titled.isin("", "设备", "医用设备"), titled).alias("t"))
    items = let(both, lambda x: F.when(x["t"].isNotNull() & ~F.exists(x["l"], lambda i: i["raw_name"] == x["t"]), F.concat(F.array(_item(x["t"], category=kind)), x["l"])).otherwise(x["l"]))
    lead = "(?:截至|截止|调研时间|提交时间|报名时限|填报时间)"
    exact = _said(p.joined, f"({lead}[^。；;]{{0,80}}?{_DAY_OPEN}[^0-9]{{0,20}}{_CLOCK})", f"({_DAY_OPEN}[^0-9]{{0,20}}{_CLOCK})\\s*(?:止|截止)")
    by_day = F.get(F.filter(F.regexp_extract_all(p.joined, F.lit(f"({lead}[^。；;]{{0,100}})"), F.lit(1)), lambda s: s.rlike(_DAY_OPEN)), F.lit(0))
    published = _said(p.text, r"时间\s*[：:]\s*(" + _EITHER + ")")
    return {
        "project_name": p.title,
        "published": published,
        "published_at": _day(published),
        "product_items": items,
        "deadline": F.when(exact.isNotNull(), _deadline(exact)).otherwise(_deadline(by_day, clock=False)),
        "notice_type": F.when(_has(p.text, "采购前") | _has(p.title, "采购前"), "采购前市场调研").otherwise("市场调研公告"),
        "department": F.when(_has(p.bare, "来源：设备科") | _has(p.title, "设备科"), "设备科"),
        "public_contact": _contact(_said(p.text, r"联系人\s*[：:]?\s*([^\s，。；;]{1,10})"), _said(p.text, r"(?:联系电话|设备科电话)\s*[：:]?\s*" + _LINE), title=_word(p.text, "设备科"), needs_number=True),
    }


def _tjzxfc_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("INDEX_PUBLISHED_DATE_INVALID", _is_day(p.index_day)),
        ("HOSPITAL_IDENTITY_NOT_FOUND", _has(p.text, "天津市中心妇产科医院")),
        ("TITLE_MISMATCH", F.contains(p.bare, p.bare_title)),
        ("PUBLISHED_DATE_NOT_FOUND", f["published"].isNotNull()),
        ("PUBLISHED_DATE_INVALID", f["published_at"].isNotNull()),
        ("PUBLISHED_DATE_MISMATCH", _same_day(f, p)),
        ("NOT_MARKET_RESEARCH", _has(p.text, "调研")),
        ("NON_MEDICAL_EARLY_SIGNAL", _in_scope(p.title, F.array_join(_names_of(f["product_items"], "raw_name", "category"), "\n"))),
        ("REGISTRATION_DEADLINE_NOT_FOUND", f["deadline"]["said"].isNotNull()),
        ("DEADLINE_INVALID", F.coalesce(f["deadline"]["at"], f["deadline"]["day"]).isNotNull()),
    ]


# ---- G and H: a research and an intent of one hospital; products named in a sentence, in the title or in a list of core needs.


def _listed_names(raw: Column, heaps: str) -> Column:
    """Distinct names of an enumeration, without the words for a project at its end and for a heap at theirs."""
    whole = F.regexp_replace(F.btrim(_bare(raw), F.lit(_EDGES_STOP)), r"(?:采购项目(?:服务)?|项目)$", "")
    names = F.transform(F.split(whole, "[、，,]"), lambda n: F.trim(F.regexp_replace(F.btrim(n, F.lit(_EDGES_STOP)), f"等(?:{heaps})?$", "")))
    return F.coalesce(F.transform(F.array_distinct(F.filter(names, lambda n: n != "")), lambda n: _item(n)), _no_items())


def _categories(title: Column) -> Column:
    return F.when(_has(title, "耗材", "试剂"), F.array(F.lit("医用耗材"))).when(_has(title, "医疗设备", "医疗器械"), F.array(F.lit("医疗设备"))).otherwise(F.array().cast("array<string>"))


def _core_needs(text: Column) -> Column:
    """Items of 核心需求清单: a number, a name, a colon and what it is for."""
    section = F.regexp_extract(text, r"核心需求清单\s*(.{1,2500}?)(?=四[、.]|供应商资质与服务要求)", 1)
    body = F.regexp_extract(section, r"(?:^|\s)\d+[.、]\s*(.*)$", 1)
    shape = r"^([^：:]{1,80}?)(?:（[^）]{1,40}）|\([^)]{1,40}\))?\s*[：:]\s*(.+)$"
    told = F.filter(F.split(body, r"\s+\d+[.、]\s+"), lambda x: x.rlike(shape))
    return _first_of_name(F.transform(told, lambda x: _item(F.btrim(_bare(F.regexp_extract(x, shape, 1)), F.lit(_EDGES_STOP)), specification=F.nullif(F.btrim(F.regexp_extract(x, shape, 2), F.lit(" ：:，,。；;")), F.lit("")))))


def _tjzyefy(p: Page) -> dict[str, Column]:
    heaps = "医疗设备|医用耗材|耗材|试剂"
    raw = _said(p.text, r"我院拟对(.{1,500}?)进行院内调研")
    by_title = _said(p.bare_title, r"[-—](.+?)(?:医疗设备采购项目|医用耗材(?:（试剂）)?采购项目|耗材采购项目|试剂采购项目)")
    general = _said(p.bare_title, r"^关于(.{1,120}?)的调研公告$")
    filled = lambda x, other: let(x, lambda y: F.when(F.size(y) > 0, y).otherwise(other))
    items = filled(_listed_names(F.coalesce(raw, by_title), heaps), filled(_core_needs(p.text), _listed_names(general, heaps)))
    part = lambda label: _said(p.joined, label + r"\s*[：:]?\s*([^。；;]{1,100})")
    phone = r"(?:联系电话|技术咨询)\s*[：:]?\s*" + _LINE
    name = F.coalesce(_said(p.text, r"联系人\s*[：:]?\s*([^\s，。；;]{1,12})"), _said(p.text, r"(?:联系电话|技术咨询)\s*[：:]?\s*(?:0?\d{2,3}-?\d{7,8}|\d{7,12})\s*([^\s，。；;]{1,12}(?:老师|先生|女士))"))
    published = _said(p.text, _ALONE % _DASHED)
    inner = _has(p.text, "院内调研")
    until = F.coalesce(part("报名时间"), part("方案报送截止"))
    return {
        "project_name": p.title,
        "published": published,
        "published_at": _day(published),
        "product_items": items,
        "product_categories": _categories(p.bare_title),
        "window": until,
        "label": F.when(part("报名时间").isNotNull(), "报名时间").otherwise("方案报送截止"),
        "deadline": let(until, lambda x: _deadline(F.when(x.rlike(_DAY_OPEN), x))),
        "inner": inner,
        "structured": _has(p.text, "项目背景与目标") & _has(p.text, "核心需求清单") & _has(p.text, "方案报送截止"),
        "notice_type": F.when(_has(p.title, "耗材", "试剂"), "医用耗材（试剂）调研公告").when(inner | _has(p.title, "院内调研"), "院内调研公告").otherwise("调研公告"),
        "public_contact": _contact(name, _said(p.text, phone), _said(p.text, r"(?:电子邮箱|发送邮箱|邮箱)\s*[：:]?\s*" + _MAIL), _word(p.text, "国有资产管理科"), needs_number=True),
    }


def _tjzyefy_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("INDEX_PUBLISHED_DATE_INVALID", _is_day(p.index_day)),
        ("HOSPITAL_IDENTITY_NOT_FOUND", _has(p.text, "天津中医药大学第二附属医院")),
        ("TITLE_MISMATCH", F.contains(p.bare, p.bare_title)),
        ("PROCUREMENT_INTENT_NOT_SUPPORTED", ~_has(p.title, "采购意向公告") & ~_has(F.substring(p.text, 1, 500), "采购意向公告")),
        ("NOT_MARKET_RESEARCH", _has(p.title, "调研") & (f["inner"] | f["structured"])),
        ("PUBLISHED_DATE_NOT_FOUND", f["published"].isNotNull()),
        ("PUBLISHED_DATE_INVALID", f["published_at"].isNotNull()),
        ("PUBLISHED_DATE_MISMATCH", _same_day(f, p)),
        ("NON_MEDICAL_RESEARCH", _in_scope(p.title, F.array_join(f["product_categories"], "\n"), F.array_join(_names_of(f["product_items"], "raw_name", "specification"), "\n"))),
        ("PRODUCT_ITEMS_NOT_FOUND", F.size(f["product_items"]) > 0),
        ("REGISTRATION_WINDOW_NOT_FOUND", f["window"].isNotNull()),
        ("REGISTRATION_DATE_NOT_FOUND", f["deadline"]["said"].isNotNull()),
        ("REGISTRATION_DATE_INVALID", _day(f["deadline"]["said"]).isNotNull()),
        ("REGISTRATION_TIME_INVALID", F.coalesce(f["deadline"]["at"], f["deadline"]["day"]).isNotNull()),
    ]


def _intent(p: Page) -> dict[str, Column]:
    published = _said(p.text, _ALONE % _DASHED)
    raw = F.coalesce(_said(p.text, r"我院将于近期对(?:天津中医药大学第二附属医院)?(.{1,300}?)进行采购"), _said(p.bare_title, r"[-—](.+?)(?:采购项目|项目)$"))
    told = F.lower(F.regexp_extract(p.bare, r"本项目具体招标信息请(?:于近期)?关注[：:]?(.{1,220}?)(?=联系电话|联系人|$)", 1))
    return {
        "project_name": p.title,
        "published": published,
        "published_at": _day(published),
        "product_items": _listed_names(raw, "医疗设备|医用耗材|耗材|试剂|设备"),
        "product_categories": _categories(p.bare_title),
        "notice_type": F.lit("采购意向公告"),
        "window": _bare(_said(p.text, r"预计采购时间\s*(?:为|[:：])?\s*(20\d{2}\s*年\s*\d{1,2}(?:\s*[-—至]\s*\d{1,2})?\s*月)")),
        "follow": let(told, lambda t: F.array_compact(F.array(*[F.when(_has(t, *words), F.lit(code)) for code, words in FOLLOW_SOURCES.items()]))),
        "public_contact": _contact(_said(p.text, r"联系人\s*[：:]?\s*([^\s，,。；;、]{1,12})"), _said(p.text, r"联系电话\s*[：:]?\s*" + _LINE)),
    }


def _intent_faults(p: Page, f: Column) -> list[tuple[str, Column]]:
    return [
        ("INDEX_PUBLISHED_DATE_INVALID", _is_day(p.index_day)),
        ("HOSPITAL_IDENTITY_NOT_FOUND", _has(p.text, "天津中医药大学第二附属医院")),
        ("TITLE_MISMATCH", F.contains(p.bare, p.bare_title)),
        ("NOTICE_TYPE_NOT_FOUND", _has(p.title, "采购意向公告") & _has(F.substring(p.text, 1, 600), "采购意向公告")),
        ("SUPPLIER_CONSULTATION_NOT_FOUND", _has(p.text, "欢迎") & _has(p.text, "供应商咨询", "服务商咨询")),
        ("PUBLISHED_DATE_NOT_FOUND", f["published"].isNotNull()),
        ("PUBLISHED_DATE_INVALID", f["published_at"].isNotNull()),
        ("PUBLISHED_DATE_MISMATCH", _same_day(f, p)),
        ("NON_MEDICAL", _in_scope(p.title, F.array_join(f["product_categories"], "\n"), F.array_join(_names_of(f["product_items"], "raw_name"), "\n"))),
        ("PRODUCT_ITEMS_NOT_FOUND", F.size(f["product_items"]) > 0),
    ]


def _no_time(f: Column) -> list[Column]:
    return [F.when(f["deadline"]["day"].isNotNull(), NO_TIME)]


def _intent_flags(f: Column) -> list[Column]:
    follow = [F.when(F.array_contains(f["follow"], code), FOLLOW + code) for code in FOLLOW_SOURCES]
    return [F.when(f["window"].isNotNull(), WINDOW), F.concat(F.lit(WINDOW_TEXT), f["window"]), *follow]


_ARTICLE = r"/system/(20\d{2})/(\d{2})/(\d{2})/(\d+)\.shtml$"
_WHOLE = "^" + _ARTICLE
_HOSTS = lambda name: [name, f"www.{name}"]


def _proved(hospital: str, **locators) -> dict:
    return {"project_name": locators.pop("project_name"), "buyer_name": hospital, "hospital_name": hospital, **locators}


# Hosts, words of titles and, by fact, where a page proves it.
SITES = {
    "teda": Site(
        "teda", "TEDA", "teda", "天津市泰达医院", _HOSTS("tedahospital.com.cn"), r"^/article/show/9/(\d+)/*$",
        lambda t: _has(t, "设备需求调研", "论证邀请公告", "产品介绍论证") & ~_has(t, "中标", "结果", "终止", "招标公告", "遴选结果"),
        "MARKET_RESEARCH",
        _proved(
            "医院官网主体/正文", project_name="详情页标题", region="天津市泰达医院官方页面主体", lifecycle_state="正文明确为医疗设备采购需求调研或采购前论证；确定性生命周期映射", notice_type="详情页标题/正文调研类型",
            published_at=lambda f: F.when(f["signed"].isNull(), "官方招标公告列表发布日期").otherwise("正文落款发布日期"), product_items="一、拟采购设备项目/设备明细",
            registration_deadline="报名截止时间", registration_deadline_date="报名截止时间", budget_cny="拟采购设备项目/设备明细预算", public_contact="调研文件提交/联系方式",
        ),
        _teda, _teda_faults, dated="tail", newest_first=False, flags=_no_time, one_host=False,
    ),
    "tjmugh": Site(
        "tjmugh", "TJMUGH", "tjmugh", "天津医科大学总医院", _HOSTS("tjmugh.com.cn"), _ARTICLE, lambda t: _has(t, "医疗设备") & _has(t, "市场调研"), "MARKET_RESEARCH",
        _proved(
            "医院官网与正文主体", project_name="页面标题", region="医院官网主体/天津医科大学总医院", lifecycle_state="正文=拟开展院内项目市场调研论证/确定性生命周期映射", notice_type="页面标题/市场调研论证邀请函", published_at="页面发布时间",
            registration_deadline="本次报名截止时间", product_items="一、论证项目名称", public_contact="三、联系方式/联系电话",
        ),
        _tjmugh, _tjmugh_faults, one_host=False,
    ),
    "tjnothop": Site(
        "tjnothop", "TJNOTHOP", "tjnothop", "天津市天津医院", _HOSTS("tjnothop.cn"), _ARTICLE, lambda t: F.startswith(t, F.lit("天津市天津医院")) & _has(t, "采购项目调研公告") & ~_has(t, "招聘"), "MARKET_RESEARCH",
        _proved(
            "详情页标题/医院官网主体", project_name="详情页标题", region="天津市天津医院官方页面主体", lifecycle_state="正文=开展采购需求调查/供应商参与调研；确定性生命周期映射", notice_type="详情页标题=采购项目调研公告",
            published_at="官方新闻中心/通知公告列表发布日期", registration_deadline_date="报名及资质提交时间的结束日期；原文未公布具体时分", product_items="一、产品要求/产品名称与采购数量", budget_cny="一、产品要求/预算金额", public_contact="联系电话/设备物资科",
        ),
        _tjnothop, _tjnothop_faults, upgraded=False, dated="tail", flags=_no_time,
    ),
    "tjfch": Site(
        "tjfch", "TJFCH", "tjfch", "天津市第一中心医院", _HOSTS("tjfch.com.cn"), _ARTICLE, _selection_wanted, "BIDDING",
        _proved(
            "天津市第一中心医院官方院内比选页面主体", project_name="详情页完整标题（H1优先、文档title兜底）与官方列表标题/截断前缀一致", region="天津市第一中心医院官方页面主体", lifecycle_state="详情页完整标题=院内比选采购公告；确定性映射为BIDDING",
            notice_type="官方栏目=院内比选采购信息；详情页完整标题含院内比选公告", published_at="详情页发布日期与/system/YYYY/MM/DD/路径日期一致", bid_deadline="响应/投标文件递交截止时间，原文含明确日期和时分", procurement_method="详情页标题/正文明确采用院内比选",
            project_number="项目编号", budget_cny="项目预算/最高限价/预算金额", public_contact="项目联系方式/联系人/电话/政务邮箱",
        ),
        _tjfch, _tjfch_faults, upgraded=False,
    ),
    "tjfch_test": Site(
        "tjfch", "TJFCH_TEST", "tjfch-test", "天津市第一中心医院", _HOSTS("tjfch.com.cn"), _ARTICLE, lambda t: _has(t, "测试企业征集公告") & ~_has(t, "评分细则", "测试结果", "征集结果", "成交公告", "中标公告"), "PRE_MARKET_RESEARCH",
        _proved(
            "天津市第一中心医院官方页面主体", project_name="详情页标题与官方院务公开入口标题一致", region="天津市第一中心医院官方页面主体", lifecycle_state="正文明确本次测试调研仅为采购前期需求核实；确定性映射为PRE_MARKET_RESEARCH", notice_type="详情页标题=测试企业征集公告",
            published_at="详情页标题下方官方发布日期", public_contact="详情页联系电话/咨询电话/报名邮箱",
        ),
        _tjfch_test, _tjfch_test_faults, upgraded=False, dated="none", newest_first=False, flags=lambda f: [F.lit(SEVEN_DAYS)],
    ),
    "tjzxfc": Site(
        "tjzxfc", "TJZXFC", "tjzxfc", "天津市中心妇产科医院", _HOSTS("tjzxfc.cn"), _WHOLE, lambda t: _has(t, "市场调研", "采购前调研", "调研邀请公告"), "MARKET_RESEARCH",
        _proved(
            "天津市中心妇产科医院官方页面主体", project_name="详情页标题与官方招标公告列表标题一致", region="天津市中心妇产科医院官方页面主体", lifecycle_state="正文明确为采购前/院内市场调研；确定性生命周期映射", notice_type="详情页标题/正文市场调研表述",
            published_at="详情页“时间”字段，并与官方详情URL日期一致", department="详情页来源或标题明确为设备科", registration_deadline="正文截止/提交/填报时间，包含官方具体时分", registration_deadline_date="正文截止/提交/填报日期；原文未公布具体时分",
            product_items="正文调研设备表格或详情页采购项目标题/科室用途", public_contact="正文联系电话/设备科电话",
        ),
        _tjzxfc, _tjzxfc_faults, flags=_no_time,
    ),
    "tjzyefy": Site(
        "tjzyefy", "TJZYEFY", "tjzyefy", "天津中医药大学第二附属医院", _HOSTS("tjzyefy.com"), _WHOLE, lambda t: _has(t, "调研") & ~_has(t, "采购意向") & _in_scope(t), "MARKET_RESEARCH",
        _proved(
            "天津中医药大学第二附属医院官方页面主体", project_name="官方公告详情页标题与公告通知列表标题一致", region="天津中医药大学第二附属医院官方页面主体",
            lifecycle_state=lambda f: F.when(f["inner"], "正文明确为院内调研；确定性生命周期映射").otherwise("官方标题为调研公告，正文同时包含项目背景与目标、核心需求清单和方案报送截止；确定性生命周期映射"),
            notice_type="详情页标题明确调研公告类型", published_at="详情页官方发布时间，并与详情URL日期一致",
            product_items=lambda f: F.when(f["inner"], "正文“我院拟对…进行院内调研”明确产品/设备/维保对象").otherwise("正文“核心需求清单”逐项明确调研对象及用途说明"), product_categories="详情页标题明确医疗设备或医用耗材/试剂类别",
            registration_deadline=lambda f: F.concat(F.lit("正文“"), f["label"], F.lit("”明确结束日期及官方具体时分")), registration_deadline_date=lambda f: F.concat(F.lit("正文“"), f["label"], F.lit("”明确结束日期；原文未公布具体时分")),
            public_contact="正文公开的邮箱、联系人或技术咨询电话",
        ),
        _tjzyefy, _tjzyefy_faults, flags=_no_time,
    ),
    "tjzyefy_intent": Site(
        "tjzyefy_intent", "TJZYEFY_INTENT", "tjzyefy-intent", "天津中医药大学第二附属医院", _HOSTS("tjzyefy.com"), _WHOLE, lambda t: _has(t, "采购意向公告"), "PROCUREMENT_INTENT",
        _proved(
            "天津中医药大学第二附属医院官方页面主体", project_name="官方采购意向详情页标题与公告通知列表标题一致", region="天津中医药大学第二附属医院官方页面主体", lifecycle_state="标题与正文明确为采购意向公告；确定性映射为PROCUREMENT_INTENT", notice_type="详情页标题明确采购意向公告",
            published_at="详情页官方发布时间，并与详情URL日期一致", product_items="正文“近期对…进行采购”及详情页项目标题明确采购对象", product_categories="详情页标题明确医疗设备或医用耗材/试剂类别", public_contact="正文欢迎供应商咨询并公布联系人/联系电话",
        ),
        _intent, _intent_faults, flags=_intent_flags,
    ),
}

_FACTS = {
    "project_number": "string", "project_name": "string", "buyer_name": "string", "hospital_name": "string", "department": "string", "region": "string", "lifecycle_state": "string", "notice_type": "string",
    "published_at": "string", "registration_deadline": "string", "registration_deadline_date": "string", "bid_deadline": "string", "expected_procurement_at": "string", "expected_procurement_precision": "string",
    "budget_cny": "bigint", "procurement_method": "string", "product_categories": "array<string>", "product_items": ITEM, "public_contact": "struct<name:string,title:string,phone:string,email:string>",
}
_EVIDENCE = "array<struct<field_path:string,source_url:string,locator:string>>"


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def article_day(url: Column, site: Site) -> Column:
    """The day that an article's path states, if there is one and the calendar has it."""
    return F.concat_ws("-", *[F.regexp_extract(_path(url), _ARTICLE, i) for i in (1, 2, 3)]).try_cast("date").cast("string")


def opportunity_id(url: Column, site: Site) -> Column:
    """The stable id of an article, out of its path; NULL if the path is none of an article."""
    known = _path(url).rlike(site.path)
    if site.path not in (_ARTICLE, _WHOLE):
        return F.when(known, F.concat(F.lit(f"{site.ids}_"), F.regexp_extract(_path(url), site.path, 1)))
    part = lambda i: F.regexp_extract(_path(url), site.path, i)
    return F.when(known & article_day(url, site).isNotNull(), F.concat(F.lit(f"{site.ids}_"), part(1), part(2), part(3), F.lit("_"), part(4)))


def candidates(html: Column, base: Column, site: Site) -> Column:
    """array of struct(published_at, url, title, opportunity_id): the links of an index page to articles of the site's kind.

    Of one address the first link counts. In the page's order, or the last published first.
    """

    def read(r: Column) -> Column:
        full = absolute_url(r["href"], base)
        url = official_url(full, None, site.hosts) if site.upgraded else F.when(full.rlike("(?i)^https:"), official_url(full, None, site.hosts))
        day = {"path": lambda u: article_day(u, site), "tail": lambda u: _day(_said(r["tail"], _ALONE % _EITHER)), "none": lambda u: F.lit(None).cast("string")}[site.dated]
        return let(url, lambda u: F.struct(day(u).alias("published_at"), u.alias("url"), r["title"].alias("title"), opportunity_id(u, site).alias("opportunity_id")))

    wanted = F.filter(links_with_tails(html), lambda r: site.wanted(_bare(r["title"])))
    found = F.filter(F.transform(wanted, read), lambda r: r["opportunity_id"].isNotNull())
    once = let(found, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["url"]), x["url"]) == i + 1))
    return F.reverse(F.array_sort(F.transform(once, lambda x: F.struct(F.coalesce(x["published_at"], F.lit("")).alias("k"), x["url"].alias("u"), x.alias("x"))))) if site.newest_first else F.transform(once, lambda x: F.struct(F.lit("").alias("k"), x["url"].alias("u"), x.alias("x")))


def index_candidates(pages: DataFrame, site: str = "site", url: str = "url", html: str = "html", sites: dict[str, Site] = SITES) -> DataFrame:
    """(site, index_url, place, opportunity_id, title, url, published_at) of index pages; pages of unknown sites and of other hosts have none."""
    of = lambda s: F.when((F.col(site) == s) & web_host(F.col(url)).isin(sites[s].hosts), candidates(F.col(html), F.col(url), sites[s]))
    rows = pages.select(F.col(site).alias("site"), F.col(url).alias("index_url"), F.posexplode(F.coalesce(*map(of, sites))).alias("place", "c"))
    return rows.select("site", "index_url", "place", *[F.col(f"c.x.{n}").alias(n) for n in ("opportunity_id", "title", "url", "published_at")])


def since(found: DataFrame, first_day: str, last_day: str, most: int) -> DataFrame:
    """Of each index page's candidates the first so many that were published within these days."""
    place = F.row_number().over(Window.partitionBy("site", "index_url").orderBy("place"))
    return found.where(F.col("published_at").between(first_day, last_day)).withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def _record(p: Page, site: Site) -> Column:
    """struct(facts, evidence, quality_flags, error_code) of an article by the rules of its site."""
    found = site.find(p)

    def of(f: Column) -> Column:
        host = web_host(p.url)
        first = [("SOURCE_URL_REJECTED" if site.path not in (_ARTICLE, _WHOLE) else "SOURCE_HOST_REJECTED", host.isin(site.hosts) & (opportunity_id(p.url, site).isNotNull()))]
        if site is not SITES["tjmugh"]:
            first.append(("INDEX_URL_REJECTED" if site.path not in (_ARTICLE, _WHOLE) else "INDEX_HOST_REJECTED", web_host(p.index_url).isin(site.hosts)))
        if site.one_host:
            first.append(("INDEX_DETAIL_HOST_MISMATCH", host == web_host(p.index_url)))
        code = error_code([(f"{site.prefix}_{c}", ok) for c, ok in [*first, *site.faults(p, f)]])
        return let(code, lambda c: F.struct(F.when(c.isNull(), facts(f)).alias("facts"), F.when(c.isNull(), F.array_compact(F.array(*site.flags(f))).cast("array<string>")).alias("quality_flags"), F.when(c.isNull(), f).alias("f"), c.alias("error_code")))

    def facts(f: Column) -> Column:
        told = {k: f[k] for k in found if k in _FACTS} | {"buyer_name": F.lit(site.hospital), "hospital_name": F.lit(site.hospital), "region": F.lit("天津市"), "lifecycle_state": F.lit(site.state)}
        if "items" in found:  # priced one by one: the whole is priced if all are
            told["product_items"] = F.transform(f["items"], lambda x: x["i"])
            told["budget_cny"] = F.when(F.forall(f["items"], lambda x: x["priced"]), F.aggregate(f["items"], F.lit(0).cast("long"), lambda a, x: a + x["b"]))
            told["published_at"] = F.coalesce(f["signed_day"], p.index_day)
        if "deadline" in found:
            told |= {"bid_deadline": f["deadline"]["at"]} if site.state == "BIDDING" else {"registration_deadline": f["deadline"]["at"], "registration_deadline_date": f["deadline"]["day"]}
        empty = {"product_categories": F.array().cast("array<string>"), "product_items": _no_items()}
        return F.struct(*[F.coalesce(told[k], empty[k]).alias(k) if k in told and k in empty else told.get(k, empty.get(k, F.lit(None).cast(t))).cast(t).alias(k) for k, t in _FACTS.items()])

    def proved(r: Column) -> Column:
        """One entry for each filled fact, in the order of the locators."""
        from_index = (r["f"]["signed"].isNull() if "signed" in found else F.lit(site is SITES["tjnothop"]))
        entries = []
        for fact, locator in site.locators.items():
            value = r["facts"][fact]
            there = F.size(value) > 0 if _FACTS[fact].startswith("array") else value.isNotNull()
            where = F.when(from_index, p.index_url).otherwise(p.url) if fact == "published_at" else p.url
            entries.append(F.when(there, F.struct(F.lit(f"facts.{fact}").alias("field_path"), where.alias("source_url"), (locator(r["f"]) if callable(locator) else F.lit(locator)).alias("locator"))))
        return F.when(r["error_code"].isNull(), F.array_compact(F.array(*entries)).cast(_EVIDENCE))

    return let(let(F.struct(*[c.alias(k) for k, c in found.items()]), of), lambda r: F.struct(r["facts"].alias("facts"), proved(r).alias("evidence"), r["quality_flags"].alias("quality_flags"), r["error_code"].alias("error_code")))


def site_records(articles: DataFrame, site: str = "site", url: str = "url", html: str = "html", index_url: str = "index_url", index_day: str = "published_at", title: str = "title", sites: dict[str, Site] = SITES) -> DataFrame:
    """articles with opportunity_id, source_id, facts, evidence, quality_flags and error_code by the rules of their sites; the page itself is left out.

    title, index_url and index_day are what the index said. A site without rules has error_code SITE_UNKNOWN.
    Columns of the input that have one of these names are replaced.
    """
    new = ["opportunity_id", "source_id", "facts", "evidence", "quality_flags", "error_code"]
    # The parsed page passes a Generate, so that it is read once however often it is named.
    kept = [F.col(c) for c in articles.columns if c not in (html, *new)]
    parsed = articles.select(*kept, heading(F.col(html)).alias("_head"), F.explode(F.array(page_parts(html))).alias("_p"))
    said = F.struct(
        F.col("_p.text").alias("t"), F.regexp_replace("_p.text", r"(?<=\d) +(?=\d)", "").alias("j"), F.regexp_replace("_p.text", " ", "").alias("b"), F.col("_head").alias("h"), F.col("_p.rows").alias("r"),
        F.coalesce(F.col(title), F.lit("")).alias("n"), _bare(F.coalesce(F.col(title), F.lit(""))).alias("c"),
    )

    def of(s: Column, rules: Site) -> Column:
        return _record(Page(s["t"], s["j"], s["b"], s["h"], s["r"], s["n"], s["c"], F.col(url), F.col(index_url), F.col(index_day)), rules)

    by_site = lambda what: F.coalesce(*[F.when(F.col(site) == k, what(s)) for k, s in sites.items()])
    record = let(said, lambda s: by_site(lambda rules: of(s, rules)))
    ids = by_site(lambda rules: opportunity_id(F.col(url), rules))
    out = parsed.select(*kept, ids.alias("opportunity_id"), by_site(lambda r: F.lit(r.source)).alias("_source"), F.explode(F.array(record)).alias("_r"))
    return out.select(
        *kept, "opportunity_id", F.concat_ws(":", "_source", "opportunity_id").alias("source_id"), "_r.facts", "_r.evidence", "_r.quality_flags", F.when(F.col("_r").isNull(), "SITE_UNKNOWN").otherwise(F.col("_r.error_code")).alias("error_code")
    )
