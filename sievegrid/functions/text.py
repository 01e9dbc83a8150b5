"""Text, address and identity expressions. White space is Unicode white space throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, in which x is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def collapse(x: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def match_key(x: Column, dropped: str = r"[\p{P}\p{S}\p{Z}\s]+") -> Column:
    """Lower case without punctuation, symbols and space: equal keys mean the same name."""
    return F.regexp_replace(F.lower(F.trim(x)), dropped, "")


def capped(x: Column, most: int) -> Column:
    """Trimmed, then cut to so many characters; empty becomes NULL."""
    return F.nullif(F.substring(F.trim(x), 1, most), F.lit(""))


def blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def any_term(terms: list[str]) -> str:
    """A pattern for any of these terms, taken literally."""
    return "|".join(f"\\Q{t}\\E" for t in sorted(terms, key=lambda t: (-len(t), t)))


def acronym_pattern(acronyms: list[str]) -> str:
    """Any acronym, in any case, that no ASCII letter or digit touches."""
    return f"(?i)(?<![A-Za-z0-9])(?:{any_term(acronyms)})(?![A-Za-z0-9])"


_WEB = r"(?i)^(https?):/*(?:([^/?#@]*)@)?([^/?#:@\s]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"


def absolute_url(x: Column, base: Column) -> Column:
    """x as seen from the page at base: absolute, of the same scheme, host, folder or page. Steps up (..) are taken, eight at most."""
    x = F.trim(x)
    origin = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.\-]*://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page.rlike(r"://[^/]+/"), F.regexp_extract(page, r"^(.*/)", 1)).otherwise(F.concat(page, F.lit("/")))
    out = (
        F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), x)
        .when(F.startswith(x, F.lit("//")), F.concat(F.regexp_extract(origin, r"^([^:]+:)", 1), x))
        .when(F.startswith(x, F.lit("/")), F.concat(origin, x))
        .when(F.startswith(x, F.lit("?")), F.concat(page, x))
        .when((x == "") | F.startswith(x, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), x))
        .otherwise(F.concat(folder, x))
    )
    out = F.regexp_replace(out, r"/(?:\./)+", "/")
    for _ in range(8):
        out = F.regexp_replace(out, r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return F.regexp_replace(out, r"(://[^/?#]+)(?:/\.\.)+/", "$1/")


def official_url(x: Column, base: Column | None = None, hosts: list[str] | Column | None = None) -> Column:
    """The https form of a web address: host in lower case, no fragment, no slash at the end of a path but the root's.

    NULL if it is no web address, carries credentials, has a port other than https's, or if its host
    is not among hosts (lower case). base: the page on which a relative address stands.
    """
    full = F.trim(x) if base is None else absolute_url(x, base)
    scheme, user, name, port, path, query = (F.regexp_extract(full, _WEB, i) for i in range(1, 7))
    plain = (port == "") | (port == "443") | ((port == "80") & (F.lower(scheme) == "http"))
    shown = F.concat(F.lit("https://"), F.lower(name), F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/")), F.when(query == "?", "?").otherwise(query))
    known = full.rlike(_WEB) & (user == "") & plain
    if hosts is not None:
        known = known & (F.array_contains(hosts, F.lower(name)) if isinstance(hosts, Column) else F.lower(name).isin(hosts))
    return F.when(known, shown)


def canonical_https(x: Column) -> Column:
    """An https address with its network part in lower case and without fragment; NULL of anything else."""
    parts = r"(?i)^(https)://([^/?#]*)([^#]*)(?:#.*)?$"
    net = F.lower(F.regexp_extract(x, parts, 2))
    return F.when(x.rlike(parts) & (F.regexp_replace(F.regexp_replace(net, "^.*@", ""), ":[0-9]*$", "") != ""), F.concat(F.lit("https://"), net, F.regexp_extract(x, parts, 3)))


def host(x: Column, unknown: str = "unknown-public-source") -> Column:
    return F.coalesce(F.lower(F.try_parse_url(x, F.lit("HOST"))), F.lit(unknown))


def stable_id(prefix: str, x: Column) -> Column:
    """prefix and the first 16 hex digits of the SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(x, 256), 1, 16))


def canonical_json_hash(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object of these fields, names in order and NULLs kept."""
    whole = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def fnv1a(x: Column, n: int) -> Column:
    """FNV-1a, 32 bits, over the code units of x, modulo n."""
    # 16777619 = 2**24 + 403: the product stays within a long when the high part is cut first.
    step = lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * 403 + F.shiftleft(h.bitwiseXOR(c.cast("long")).bitwiseAND(F.lit(0xFF)), 24), F.lit(1 << 32))
    raw = F.encode(x, "UTF-16BE")
    units = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.conv(F.hex(F.substring(raw, i * 2 - 1, 2)), 16, 10))
    folded = F.aggregate(F.when(F.length(x) > 0, units).otherwise(F.array().cast("array<string>")), F.lit(2166136261).cast("long"), step)
    return F.pmod(folded, F.lit(n)).cast("int")


def anchor_set_fingerprint(anchors: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of an array of anchors (url, title) as JSON, whatever its order."""
    pairs = F.array_sort(F.transform(anchors, lambda a: F.array(a["url"], a["title"])))
    return F.substring(F.sha2(F.to_json(pairs), 256), 1, 32)


def reminder_id(user: Column, opportunity: Column, at: Column) -> Column:
    """mrem_ and the SHA-256 of user, opportunity and time, a line each."""
    return F.concat(F.lit("mrem_"), F.sha2(F.concat_ws("\n", user, opportunity, at), 256))


def amount_shown(x: Column) -> Column:
    """An amount of yuan as people read it: whole or tenths of 万元 from 10,000 on, else yuan."""
    wan = x / 10_000
    tens = F.when(x % 10_000 == 0, F.format_string("%d", (x / 10_000).cast("long"))).otherwise(F.call_function("format_number", F.round(wan, 1), F.lit("0.0")))
    return F.when(x >= 10_000, F.concat(tens, F.lit(" 万元"))).otherwise(F.concat(F.lit("¥"), F.call_function("format_number", x, F.lit("#,##0.###"))))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the values in this order, each with its length, so that no two lists look alike."""
    shown = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *shown), 256)


def set_fingerprint(items: Column) -> Column:
    """SHA-256 over an array of strings whatever its order."""
    return F.sha2(F.concat_ws("\n", F.array_sort(items)), 256)


def flag_value(flags: Column, prefix: str) -> Column:
    """Of flags like PREFIX=value the first one's value."""
    return F.substring(F.get(F.filter(flags, lambda f: F.startswith(f, F.lit(f"{prefix}="))), F.lit(0)), len(prefix) + 2, 1 << 30)


# What a label contains, and its code; the first of these counts.
REGIONS = {
    "天津": "CN-TJ", "北京": "CN-BJ", "上海": "CN-SH", "重庆": "CN-CQ", "广东": "CN-GD", "浙江": "CN-ZJ", "江苏": "CN-JS", "山东": "CN-SD", "吉林": "CN-JL",
}


def json_string(x: Column) -> Column:
    """x as a JSON string with its quotes."""
    return F.substring(F.to_json(F.struct(x.alias("x"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(x.alias("x")))) - 6)


def region_code(label: Column, regions: dict[str, str] = REGIONS) -> Column:
    """The code of the first region that the label contains, else one from the label's hash; CN-UNKNOWN of no label."""
    label = capped(label, 200)
    out = F.concat(F.lit("CN-REGION-"), F.substring(F.sha2(json_string(label), 256), 1, 10))
    for part, code in reversed(regions.items()):
        out = F.when(F.contains(label, F.lit(part)), F.lit(code)).otherwise(out)
    return F.when(label.isNull(), "CN-UNKNOWN").otherwise(out)


def market_of(label: Column, aliases: dict[str, list[str]]) -> Column:
    """The first market one of whose aliases the label begins with."""
    label, out = F.trim(label), F.lit(None).cast("string")
    for market, names in reversed(aliases.items()):
        begins = [F.startswith(label, F.lit(n)) for n in names if n]
        for hit in begins:
            out = F.when(hit, F.lit(market)).otherwise(out)
    return F.when(label != "", out)


def budget_cny(x: Column) -> Column:
    """Whole yuan from text such as '12.5万元' or '1,200,000 元'; half to even."""
    number = F.regexp_replace(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(万)?\s*元?", 1), ",", "")
    tens = F.when(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(万)?\s*元?", 2) == "万", 10_000).otherwise(1)
    return F.bround(F.nullif(number, F.lit("")).cast("decimal(20,4)") * tens, 0).cast("long")


def phone(x: Column, least_digits: int = 5) -> Column:
    """A telephone number as written, or NULL if it has too few digits."""
    return F.when(F.length(F.regexp_replace(x, r"\D", "")) >= least_digits, F.trim(x))


def section(text: Column, begin: str, end: str, most: int | None = 4000, cut: int | None = None) -> Column:
    """What stands between two markers (patterns); NULL if that is missing or longer than most. cut: keep so many characters."""
    got = F.trim(F.regexp_extract(text, f"(?s)(?:{begin})(.*?)(?:{end}|$)", 1))
    if cut is not None:
        got = F.substring(got, 1, cut)
    return let(got, lambda x: F.when((x != "") if most is None else (x != "") & (F.length(x) <= most), x))


# Units of amounts.
UNITS = [
    "台", "套", "项", "个", "条", "批", "组", "件", "盒", "瓶", "包", "支", "份", "张", "辆", "本", "册", "人", "人次", "系统", "服务", "年", "月", "次", "家", "所", "间", "种",
    "片", "枚", "把", "部", "床", "位", "台/套", "套/年", "项服务",
]
_COUNT = r"(?:\d+(?:\.\d+)?|[一二三四五六七八九十百]+)"


def is_quantity(x: Column, units: list[str] = UNITS) -> Column:
    """x is a number, in digits or Chinese numerals, alone, with a unit, or with a short note in parentheses."""
    bare = F.translate(F.regexp_replace(x, r"(?U)\s+", ""), "（）", "()")
    return F.coalesce(bare.rlike(f"^{_COUNT}(?:\\([^()\\d]{{1,8}}\\)|(?:{any_term(units)}))?$"), F.lit(False))


def quantity(x: Column, units: list[str] = UNITS) -> Column:
    """x without space around it if it is a quantity, else NULL."""
    return F.when(is_quantity(x, units), F.trim(x))


def split_names(x: Column) -> Column:
    """Distinct names of a list written with commas."""
    return F.array_distinct(F.filter(F.transform(F.split(x, "[、，,]"), lambda n: F.trim(n)), lambda n: n != ""))


# Markets by what may be chosen, and those that ids name.
MARKET_GROUPS = {"JJ": ["BJ", "TJ"], "JJJ": ["BJ", "TJ", "HE"], "NE3": ["LN", "JL", "HL"], "ALL": ["BJ", "TJ", "HE", "LN", "JL", "HL"]}


def selected_markets(choice: Column) -> Column:
    """The markets of a choice: a group's, else the one that is chosen."""
    out = F.array(choice)
    for name, markets in MARKET_GROUPS.items():
        out = F.when(choice == name, F.array(*map(F.lit, markets))).otherwise(out)
    return out


def market_of_id(x: Column, default: str = "TJ") -> Column:
    """The market that an opportunity's id names."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(x, "(?i)^ccgp_(bj|he|ln|jl|hl)_", 1)), F.lit("")), F.lit(default))
