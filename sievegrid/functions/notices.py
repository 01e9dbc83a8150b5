"""Facts of public notices as column expressions over their visible text: no Python in the scan.

Every fact is NULL unless the text states it. Local times are of +08:00 unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.text import any_term, budget_cny, collapse, let, phone, section

OFFSET = "+08:00"
_DAY = r"(20\d{2})\s*[-/年]\s*(\d{1,2})\s*[-/月]\s*(\d{1,2})\s*日?"
_CLOCK = r"(\d{1,2})\s*[:：点时]\s*(\d{2})"
# Labels as notices word them.
LABELS = {
    "project_number": ["原公告的采购项目编号", "采购项目编号", "项目编号"],
    "project_name": ["原公告的采购项目名称", "采购项目名称", "项目名称"],
    "buyer_name": ["采购人信息 名称", "采购人名称", "采购人"],
    "region": ["行政区域", "所属地区"],
}
PUBLISHED = ["更正日期", "发布日期", "公告时间"]
BID_DEADLINE = ["投标文件提交截止时间", "响应文件提交截止时间", "提交投标文件截止时间", "提交响应文件截止时间", "开标时间"]
REGISTRATION = ["获取招标文件", "获取采购文件", "报名时间"]
# What makes a notice an event, words of terms that change more than a date, and marks of what stays open.
TERMINATED = ["终止公告"]
CORRECTED = ["更正公告", "更正信息"]
MATERIAL = ["采购需求", "技术参数", "技术要求", "规格", "型号", "数量", "预算金额", "最高限价", "资格要求", "评分标准", "评标办法"]
MATERIAL_MARK, UNPARSED_MARK = "__material_correction__", "__unparsed_correction__"
# How corrections word a new time (group 1), and how they say only that one is changed.
_DASHED = r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\s+(\d{1,2})\s*[：:]\s*(\d{2})(?::\d{2})?"
_WORDED = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*(\d{1,2})\s*(?:点|时|[:：])\s*(\d{1,2})\s*分?"
NEW_TIMES = {
    "facts.bid_deadline": [
        (r"(?s)原公告的(?:投标文件|响应文件)提交截止时间\s*[：:]\s*.+?更正为\s*[：:]?\s*(20\d{2}[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}[：:]\d{2}(?::\d{2})?)", [_DASHED]),
        (r"(?s)现更正(?:投标文件提交截止时间|投标截止时间、开标时间|投标截止时间|响应文件提交截止时间|响应文件截止时间).*?[：:]\s*(20\d{2}.{0,40}?(?:点|时|[:：]).{0,8}?分?)", [_WORDED]),
    ],
    "facts.registration_deadline": [(r"(?s)原公告的获取(?:招标|采购)文件结束(?:日期|时间)\s*[：:]\s*.+?更正为\s*[：:]?\s*([^。；;]+)", [_DASHED, _WORDED])],
}
CHANGED = {
    "facts.bid_deadline": r"(?:投标文件提交截止时间|投标截止时间|响应文件提交截止时间|响应文件截止时间).{0,80}?(?:更正|调整|变更)",
    "facts.registration_deadline": r"获取(?:招标|采购)文件(?:结束日期|结束时间|截止时间).{0,80}?(?:更正|调整|变更)",
}
EVENT_NUMBERS = ["原公告的采购项目编号", "采购项目编号", "项目编号"]
EVENT_NAMES = [r"原公告的采购项目名称\s*[：:]\s*(.+?)\s+首次公告日期", r"采购项目名称\s*[：:]\s*(.+?)\s+二[、.]"]
EVENT_DATES = [r"发布日期\s*[：:]\s*(20\d{2})年(\d{1,2})月(\d{1,2})日", r"公告时间\s*[|：:]?\s*(20\d{2})年(\d{1,2})月(\d{1,2})日"]
CORRECTION_DATE = r"更正日期\s*[：:]\s*(20\d{2})[-年](\d{1,2})[-月](\d{1,2})日?"
SUMMARIES = {"TERMINATION": r"二[、.]\s*项目终止的原因\s*[：:]?(.+?)三[、.]\s*其他补充事宜", "CORRECTION": r"二[、.]\s*更正信息\s*[：:]?(.+?)三[、.]\s*其他补充(?:事宜|事项)"}
# Regions as result lists write them, and kinds of notices, the first of which counts.
REGION_NAMES = ["北京", "北京市", "天津", "天津市", "河北", "河北省", "辽宁", "辽宁省", "吉林", "吉林省", "黑龙江", "黑龙江省"]
REGION_PREFIXES = ["北京市", "天津市", "河北省", "辽宁省", "吉林省", "黑龙江省"]
REGION_SUFFIXES = ["自治县", "开发区", "高新区", "新区", "自治州", "市", "区", "县", "旗"]
NOTICE_TYPES = [
    "公开招标公告", "竞争性磋商公告", "竞争性谈判公告", "询价公告", "资格预审公告", "单一来源公告", "更正公告", "中标公告", "成交公告", "终止公告",
    "公开招标", "竞争性磋商", "竞争性谈判", "单一来源", "资格预审",
]
REGION_LENGTH = 18


def _first(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[let(F.regexp_extract(text, p, group), lambda x: F.when(x != "", x)) for p in patterns])


def labelled(text: Column, labels: list[str]) -> Column:
    """The value after the first of these labels that has one, up to a space or a stop."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(label)), _first(text, [f"{label}\\s*[：:|]\\s*([^\\s，。；;|]+)"])) for label in labels])


def day_after(text: Column, labels: list[str]) -> Column:
    """yyyy-MM-dd of the date after a label, if it is in the calendar."""
    return let(_first(text, [f"{label}\\s*[：:|]?\\s*({_DAY})" for label in labels]), _day_in)


def _day_in(part: Column) -> Column:
    shown = F.format_string("%s-%02d-%02d", F.regexp_extract(part, _DAY, 1), F.regexp_extract(part, _DAY, 2).try_cast("int"), F.regexp_extract(part, _DAY, 3).try_cast("int"))
    return F.when(part.isNotNull() & shown.try_cast("date").isNotNull(), shown)


def moment(part: Column, offset: str = OFFSET) -> Column:
    """ISO text of the first date and time of day in part; 24:00 is the next day's 00:00."""
    return let(part, lambda p: _moment(p, offset))


def _moment(part: Column, offset: str) -> Column:
    pattern = f"{_DAY}\\s*{_CLOCK}"
    numbers = F.array(*[F.regexp_extract(part, pattern, i).try_cast("int") for i in range(1, 6)])

    def of(n: Column) -> Column:
        late = (n[3] == 24) & (n[4] == 0)
        fits = (n[3] <= 23) & (n[4] <= 59) | late
        day = F.format_string("%04d-%02d-%02d", n[0], n[1], n[2]).try_cast("date")
        return F.when(fits, F.concat(F.date_add(day, F.when(late, 1).otherwise(0)).cast("string"), F.format_string("T%02d:%02d:00", F.when(late, 0).otherwise(n[3]), n[4]), F.lit(offset)))

    return F.when(part.rlike(pattern), let(numbers, of))


def deadline_after(text: Column, labels: list[str]) -> Column:
    """The moment stated within 60 characters after one of the labels."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(label)), moment(F.regexp_extract(text, f"(?s){label}(.{{1,60}})", 1))) for label in labels])


def registration_deadline(text: Column) -> Column:
    """A stated moment; else the last day of the stated period at the end of its afternoon hours."""
    return let(F.coalesce(*[F.when(F.contains(text, F.lit(label)), section(text, label, r"(?:三、|四、|地点)", 600)) for label in REGISTRATION]), _last_hours)


def _last_hours(part: Column) -> Column:
    until = F.regexp_extract(part, f"至\\s*{_DAY}", 0)
    hours = F.regexp_extract_all(part, F.lit(f"[至到\\-—]\\s*{_CLOCK}"), F.lit(0))
    last = F.try_element_at(hours, F.lit(-1))
    return F.coalesce(moment(F.regexp_extract(part, f"至\\s*({_DAY}\\s*{_CLOCK})", 1)), moment(F.concat(until, F.lit(" "), F.regexp_extract(last, _CLOCK, 0))))


def project_number(text: Column) -> Column:
    """The number, without the kind of notice that a heading may have put after it."""
    return F.nullif(F.regexp_replace(labelled(text, LABELS["project_number"]), r"[)）](?:公开招标|竞争性磋商)公告$", ""), F.lit(""))


def project_name(text: Column) -> Column:
    """The name, spaces and all, up to the next label."""
    told = [f"{label}\\s*[：:]\\s*(.+?)\\s+{end}" for label in LABELS["project_name"] for end in (r"[^\s：:]{2,12}\s*[：:]", r"预算金额")]
    return F.coalesce(_first(text, told), labelled(text, LABELS["project_name"]))


def buyer(text: Column) -> Column:
    told = [r"采购人信息\s+名称\s*[：:]\s*(.+?)\s+地址\s*[：:]", r"采购单位\s*[|：:]?\s*(.+?)\s+(?:采购单位地址|行政区域|公告时间)"]
    return F.coalesce(_first(text, told), labelled(text, LABELS["buyer_name"]))


def contact(text: Column) -> Column:
    """struct(name, title, phone, email); a telephone of too few digits is NULL, and notices state no address."""
    name = _first(text, [r"(?:项目联系人|联系人)\s*[：:]\s*([^，。；;、：:]+?)\s*(?:联系电话|联系方式|电话|[，。；;、]|$)"])
    number = _first(text, [r"(?:联系电话|联系方式|电话)\s*[：:]\s*([0-9\-—\s]{3,20})"])
    return F.when(name.isNotNull() | number.isNotNull(), F.struct(name.alias("name"), F.lit("项目联系人").alias("title"), phone(number).alias("phone"), F.lit(None).cast("string").alias("email")))


def tender_facts(text: Column) -> Column:
    """The facts struct of a tender or a consultation, with error_code of what is missing."""
    return let(collapse(text), _tender_facts)


def _tender_facts(t: Column) -> Column:
    found = {"project_number": project_number(t), "project_name": project_name(t), "buyer_name": buyer(t), "region": labelled(t, LABELS["region"])}
    found |= {
        "published_at": day_after(t, PUBLISHED),
        "registration_deadline": registration_deadline(t),
        "bid_deadline": deadline_after(t, BID_DEADLINE),
        "budget_cny": budget_cny(_first(t, [r"预算金额[^0-9]{0,12}([0-9][0-9,.]*\s*万?元)"])),
        "public_contact": contact(t),
    }
    missing = lambda f: F.coalesce(*[F.when(f[k].isNull(), f"{k.upper()}_NOT_FOUND") for k in ("project_number", "project_name", "buyer_name", "published_at")])
    return let(F.struct(*[c.alias(k) for k, c in found.items()]), lambda f: F.struct(*[f[k].alias(k) for k in found], missing(f).alias("error_code")))


def event_facts(text: Column) -> Column:
    """A correction or termination: its type, number, date, overrides, and paths left unresolved.

    A new deadline that is stated exactly overrides the old one. A deadline that is only said to be
    changed, a summary that names other terms, and a correction of which nothing is understood all
    leave something unresolved, and that suppresses the record.
    """
    return let(collapse(text), _event_facts)


def _parts(part: Column, pattern: str, shown: str) -> Column:
    """The numbers of a pattern's groups in a format; NULL without a match."""
    n = shown.count("%0")
    return F.when(part.rlike(pattern), F.format_string(shown, *[F.regexp_extract(part, pattern, i + 1).try_cast("int") for i in range(n)]))


def _new_time(text: Column, path: str) -> Column:
    """struct(changed, value) of a deadline: the first wording that is there decides."""
    said = lambda changed, value: F.struct(F.lit(changed).alias("changed"), value.alias("value"))
    none = F.lit(None).cast("string")

    def first_of(wordings: list[tuple[str, list[str]]]) -> Column:
        if not wordings:
            return F.when(text.rlike(CHANGED[path]), said(True, none)).otherwise(said(False, none))
        (wording, times), rest = wordings[0], wordings[1:]
        stated = lambda part: F.coalesce(*[_parts(part, t, f"%04d-%02d-%02dT%02d:%02d:00{OFFSET}") for t in times])
        return let(F.regexp_extract(text, wording, 1), lambda part: F.when(part != "", said(True, stated(part))).otherwise(first_of(rest)))

    return first_of(NEW_TIMES[path])


def _event_facts(t: Column) -> Column:
    kind = F.when(t.rlike(any_term(TERMINATED)), "TERMINATION").when(t.rlike(any_term(CORRECTED)), "CORRECTION")
    summary = F.when(kind == "TERMINATION", F.regexp_extract(t, SUMMARIES["TERMINATION"], 1)).when(kind == "CORRECTION", F.regexp_extract(t, SUMMARIES["CORRECTION"], 1))
    times = F.when(kind == "CORRECTION", F.array(*[F.struct(F.lit(p).alias("path"), _new_time(t, p).alias("new")) for p in sorted(NEW_TIMES)]))
    head = F.struct(kind.alias("kind"), F.nullif(F.substring(F.trim(summary), 1, 2400), F.lit("")).alias("summary"), times.alias("times"))
    return let(head, lambda h: _event_of(t, h["kind"], h["summary"], F.filter(h["times"], lambda x: x["new"]["changed"])))


def _event_of(t: Column, kind: Column, summary: Column, changed: Column) -> Column:
    correction = kind == "CORRECTION"
    none = F.array().cast("array<string>")
    open_ = F.transform(F.filter(changed, lambda x: x["new"]["value"].isNull()), lambda x: x["path"])
    marked = F.when(summary.rlike(any_term(MATERIAL)), F.concat(F.array(F.lit(MATERIAL_MARK)), open_)).otherwise(open_)
    left = F.when(correction, let(marked, lambda m: F.when((F.size(m) == 0) & (F.size(changed) == 0), F.array(F.lit(UNPARSED_MARK))).otherwise(m))).otherwise(none)
    known = F.transform(F.filter(changed, lambda x: x["new"]["value"].isNotNull()), lambda x: F.struct(x["path"].alias("key"), x["new"]["value"].alias("value")))
    number = _first(t, [f"{label}\\s*[：:]\\s*([^\\s，。；;]+)" for label in EVENT_NUMBERS])
    dates = [_parts(t, p, "%04d-%02d-%02d") for p in EVENT_DATES]
    date = F.coalesce(F.when(correction, _parts(t, CORRECTION_DATE, "%04d-%02d-%02d")), *dates)
    fields = [number.alias("project_number"), _first(t, EVENT_NAMES).alias("project_name"), date.alias("published_at"), left.alias("unresolved_fact_paths")]
    return let(
        F.struct(*fields),
        lambda f: F.struct(
            kind.alias("event_type"), f["project_number"].alias("project_number"), f["project_name"].alias("project_name"), summary.alias("summary"), f["published_at"].alias("published_at"),
            F.when(correction, F.transform(changed, lambda x: x["path"])).otherwise(none).alias("changed_fact_paths"),
            F.when(correction, F.map_from_entries(known)).otherwise(F.create_map().cast("map<string,string>")).alias("fact_overrides"),
            f["unresolved_fact_paths"].alias("unresolved_fact_paths"), (F.size(f["unresolved_fact_paths"]) > 0).alias("requires_reconciliation"), F.coalesce(kind == "TERMINATION", F.lit(False)).alias("terminal"),
            F.when(kind.isNull(), "EVENT_TYPE_NOT_FOUND").when(f["project_number"].isNull(), "PROJECT_NUMBER_NOT_FOUND").when(f["published_at"].isNull(), "PUBLISHED_DATE_NOT_FOUND").alias("error_code"),
        ),
    )


def fallback_event(event: Column, number: Column, kind: Column, date: Column) -> Column:
    """For a notice that cannot be parsed: an event that suppresses its record and rewrites nothing."""
    none = F.lit(None).cast("string")
    held = F.struct(
        kind.alias("event_type"), number.alias("project_number"), none.alias("project_name"), none.alias("summary"), date.alias("published_at"), F.array().cast("array<string>").alias("changed_fact_paths"), F.create_map().cast("map<string,string>").alias("fact_overrides"),
        F.array(F.lit(UNPARSED_MARK)).alias("unresolved_fact_paths"), F.lit(True).alias("requires_reconciliation"), (kind == "TERMINATION").alias("terminal"), F.lit(None).cast("string").alias("error_code"),
    )
    return F.when(event["error_code"].isNull(), event).otherwise(held)


def is_region(x: Column) -> Column:
    """A region as result lists write it: a known name, or an administrative unit below a known province or city."""
    unit = f"^(?:{any_term(REGION_PREFIXES)})(?:[\\u4e00-\\u9fff]*(?:{any_term(REGION_SUFFIXES)}))?$"
    return x.isin(REGION_NAMES) | ((F.length(x) <= REGION_LENGTH) & x.rlike(unit))


def search_metadata(text: Column) -> Column:
    """Date, buyer, region and kind of notice of a search row's text, parted by bars."""
    return let(F.replace(collapse(text), F.lit("："), F.lit(":")), _search_metadata)


def _search_metadata(t: Column) -> Column:
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    date = _parts(t, r"\b(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})\b", "%04d-%02d-%02d")
    kind = F.coalesce(*[F.when(F.contains(t, F.lit(k)), F.lit(k)) for k in NOTICE_TYPES])
    named = F.btrim(F.regexp_extract(t, r"(?:地域|行政区域)\s*:\s*([^|\s]+)", 1), F.lit(" ,，;；"))

    def of(p: Column) -> Column:
        is_buyer = lambda x: F.startswith(x, F.lit("采购人")) & F.contains(x, F.lit(":"))
        buyer = F.regexp_extract(F.try_element_at(F.filter(p, is_buyer), F.lit(-1)), r"^[^:]*:\s*(.*)$", 1)
        region = F.try_element_at(F.filter(p, lambda x: is_region(x) & ~is_buyer(x)), F.lit(1))
        shown = let(named, lambda n: F.when(is_region(n), n).otherwise(region))
        return F.struct(date.alias("published_at"), F.nullif(buyer, F.lit("")).alias("buyer_name"), shown.alias("region"), kind.alias("notice_type"))

    return let(parts, of)
