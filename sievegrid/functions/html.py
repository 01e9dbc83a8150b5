"""HTML to text, anchors and tables. Pages are parsed row by row in Arrow batches, one small parser each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.functions.text import official_url

_ANCHORS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType())]))
_ROWS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "href", "meta")]))
_TABLES = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
_PARTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])
_BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "table", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav"}


class _Page(HTMLParser):
    """Visible text, anchors and outermost tables in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.anchors: list[list] = []
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.hidden = self.depth = 0
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "a" and given.get("href"):
            self.anchors.append([given["href"], []])
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        if self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        if self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            span = lambda k: min(max(int(given.get(k) or 1) if (given.get(k) or "1").isdigit() else 1, 1), 100)
            self.cell = [[], span("rowspan"), span("colspan")]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        if tag in ("td", "th") and self.depth <= 1:
            self.cell = None
        if tag == "a" and self.anchors and self.anchors[-1][1] is not None:
            self.anchors[-1].append(True)

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.anchors and len(self.anchors[-1]) == 2:
            self.anchors[-1][1].append(data)
        if self.cell is not None:
            self.cell[0].append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def page_text(html: str | None) -> str:
    lines = (" ".join(x.split()) for x in "".join(_parsed(html).text).split("\n"))
    return "\n".join(x for x in lines if x)


def page_anchors(html: str | None, base: str | None) -> list[dict]:
    """Titles and absolute addresses without fragment; of equal addresses the first."""
    out: dict[str, str] = {}
    for href, title, *_ in _parsed(html).anchors:
        try:
            url = urljoin(base or "", href.strip()).split("#")[0]
        except ValueError:
            continue
        if url.startswith(("http://", "https://")):
            out.setdefault(url, _clean(title))
    return [{"title": t[:220], "url": u} for u, t in out.items()]


def page_tables(html: str | None) -> list[list[list[str]]]:
    """Outermost tables as grids: a cell that spans rows or columns stands in each place it covers."""
    return _laid_out(_parsed(html))


def _laid_out(page: _Page) -> list[list[list[str]]]:
    grids = []
    for table in page.tables:
        grid: list[dict[int, str]] = [{} for _ in table]
        for r, row in enumerate(table):
            c = 0
            for parts, down, across in row:
                while c in grid[r]:
                    c += 1
                for i in range(r, min(r + down, len(table))):
                    for j in range(c, c + across):
                        grid[i].setdefault(j, _clean(parts))
                c += across
        grids.append([[row.get(j, "") for j in range(max(row, default=-1) + 1)] for row in grid])
    return grids


def _parts_of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in pages:
        parsed = [_parsed(h) for h in part]
        texts = [" ".join(" ".join(p.text).split()) for p in parsed]
        yield pd.DataFrame({"text": texts, "rows": [[row for grid in _laid_out(p) for row in grid] for p in parsed]})


def page_parts(html: Column | str) -> Column:
    """struct(text, rows): visible texts, a space between any two, and the rows of cells of all outermost tables, read in one pass."""
    return F.pandas_udf(_parts_of, _PARTS)(html)


def _texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(page_text)


def _anchor_lists(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_anchors(h, b) for h, b in zip(html, base, strict=True)])


def _grids(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(page_tables)


def visible_text(html: Column | str) -> Column:
    """Text of a page without scripts and styles, a line per block."""
    return F.pandas_udf(_texts, T.StringType())(html)


def anchors(html: Column | str, base: Column | str, hosts: list[str] | None = None) -> Column:
    """array of struct(title, url), titles to 220 characters; hosts: only of these."""
    found = F.pandas_udf(_anchor_lists, _ANCHORS)(html, base)
    if hosts is None:
        return found
    return F.filter(found, lambda a: F.lower(F.try_parse_url(a["url"], F.lit("HOST"))).isin(hosts))


def tables(html: Column | str) -> Column:
    """The outermost tables as arrays of rows of cells."""
    return F.pandas_udf(_grids, _TABLES)(html)


def product_rows(grid: Column, names: list[str], amounts: list[str], most: int = 100) -> Column:
    """Rows (name, amount) below the first row that heads both columns; distinct, so many at most."""

    def place(row: Column, heads: list[str]) -> Column:
        return F.array_position(F.transform(row, lambda c: c.isin(heads)), F.lit(True))

    head = F.get(F.filter(F.transform(grid, lambda row, i: F.struct(i.alias("at"), place(row, names).alias("n"), place(row, amounts).alias("a"))), lambda h: (h["n"] > 0) & (h["a"] > 0)), F.lit(0))
    below = F.filter(F.transform(grid, lambda row, i: F.when(i > head["at"], F.struct(F.get(row, (head["n"] - 1).cast("int")).alias("name"), F.get(row, (head["a"] - 1).cast("int")).alias("amount")))), lambda r: r.isNotNull() & (r["name"] != ""))
    return F.slice(F.array_distinct(below), 1, most)


def regex_anchors(html: Column, most: int = 400) -> Column:
    """(url, title) of plain anchors by pattern, without a parser."""
    pattern = F.lit(r'(?is)<a\s[^>]*?href="([^"]+)"[^>]*>([^<]*)</a>')
    urls, titles = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    return F.slice(F.transform(F.arrays_zip(urls.alias("url"), titles.alias("title")), lambda a: F.struct(a["url"].alias("url"), F.trim(a["title"]).alias("title"))), 1, most)


def _decoded(content: bytes | None, declared: str | None, marks: dict[str, int] | None) -> str | None:
    """A page's text by the best of its charsets: as declared, as its head says, UTF-8, GB18030.

    marks: strict decoding, judged by the phrases found and their weights; else decoding with
    replacements, judged by CJK characters (2 each) less 20 for each replacement.
    """
    if content is None:
        return None
    head = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._-]+)", content[:8192], re.I)
    named = [declared, head and head[1].decode("ascii"), "utf-8", "gb18030"]
    best: tuple[int, str] | None = None
    for charset in dict.fromkeys("gb18030" if n.strip().lower() in ("gb2312", "gbk", "gb_2312-80") else n.strip().lower() for n in named if n):
        try:
            text = content.decode(charset, "strict" if marks is not None else "replace")
        except (LookupError, UnicodeDecodeError):
            continue
        if marks is not None:
            worth = sum(w for mark, w in marks.items() if mark in text)
        else:
            worth = 2 * len(re.findall("[\u3400-\u9fff]", text)) - 20 * text.count("\ufffd")
        if best is None or worth > best[0]:
            best = worth, text
    return best[1] if best else content.decode("utf-8", "replace")


def decode_best(content: Column | str, declared: Column | None = None, marks: dict[str, int] | None = None) -> Column:
    """Bytes as text by the charset that reads best. marks: phrases with weights that tell it, instead of the share of CJK characters."""

    def decode(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([_decoded(b, c, marks) for b, c in zip(bodies, charsets, strict=True)], dtype=object)

    return F.pandas_udf(decode, T.StringType())(content, F.lit(None).cast("string") if declared is None else declared)


# What links to a next page say.
NEXT_LABELS = ["下一页", "下页", "后一页", "next", "next page", "›", "»", ">"]


def regex_text(html: Column) -> Column:
    """Text without tags, scripts and styles, by patterns, with the common entities read."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"(?i)&nbsp;|&#160;", " ")
    for entity, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'")):
        x = F.regexp_replace(x, f"(?i){entity}", mark)
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def next_page(html: Column, base: Column, hosts: list[str] | Column | None = None) -> Column:
    """The official address of the next page: of a link element of that relation, else of the first anchor of that relation or label; NULL if none leads elsewhere."""
    href, rel = r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", r"(?i)\brel\s*=\s*[\"']([^\"']+)[\"']"
    is_next = lambda attrs: F.array_contains(F.split(F.lower(F.regexp_extract(attrs, rel, 1)), r"\s+"), "next")
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b([^>]*?)>"), F.lit(1)), is_next)
    attrs, labels = (F.regexp_extract_all(html, F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>"), F.lit(i)) for i in (1, 2))
    anchors = F.filter(F.arrays_zip(attrs.alias("a"), labels.alias("t")), lambda z: is_next(z["a"]) | F.lower(regex_text(z["t"])).isin(NEXT_LABELS))
    urls = F.transform(F.concat(links, F.transform(anchors, lambda z: z["a"])), lambda a: official_url(F.nullif(F.regexp_extract(a, href, 1), F.lit("")), base, hosts))
    return F.get(F.filter(urls, lambda u: u.isNotNull() & (u != base)), F.lit(0))


def links_with_tails(html: Column) -> Column:
    """array of struct(href, title, tail): each link with a title, and the text after it up to the next link."""
    pieces = F.split(F.coalesce(html, F.lit("")), r"(?i)<a(?=[\s>])")
    quoted = r"(?is)^[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>"
    href = lambda p: F.trim(F.regexp_extract(p, quoted, 1))
    title = lambda p: regex_text(F.regexp_extract(p, r"(?is)^[^>]*>(.*?)</a\s*>", 1))
    tail = lambda p: regex_text(F.regexp_extract(p, r"(?is)^[^>]*>.*?</a\s*>(.*)$", 1))
    found = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(href(p).alias("href"), title(p).alias("title"), tail(p).alias("tail")))
    return F.filter(found, lambda r: (r["href"] != "") & (r["title"] != ""))


def heading(html: Column) -> Column:
    """The first h1 that says something, else the first title element; NULL if there is neither."""
    said = lambda tag: F.get(F.filter(F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>"), F.lit(1)), regex_text), lambda x: x != ""), F.lit(0))
    return F.coalesce(said("h1"), said("title"))


def list_rows(html: Column | str) -> Column:
    """array of struct(title, href, meta): of each outermost item of a result list the first link and the text beside it."""
    return F.pandas_udf(_list_rows, _ROWS)(html)


#: Fixed value: the class of lists of results.
RESULT_LIST = "vT-srch-result-list-bid"


class _Tree(HTMLParser):
    """Elements as (tag, attributes, parent), and texts with the element that they stand in."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, int]] = []
        self.texts: list[tuple[int, str]] = []
        self._open: list[int] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.elements.append((tag, dict(attrs), self._open[-1] if self._open else -1))
        self._open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, max(-1, len(self._open) - 64), -1):
            if self.elements[self._open[i]][0] == tag:
                del self._open[i:]
                return

    def handle_data(self, data):
        self.texts.append((self._open[-1] if self._open else -1, data))


def result_rows(html: str | None) -> list[dict]:
    """Each element gets from its parent the outermost item of a list that it is directly in, and the link of it that it is in."""
    tree = _Tree(html)
    place: list[tuple[bool, int | None, int | None]] = []  # in a list; item, None if in none or in an inner one; its first link around this
    first: dict[int, int] = {}
    in_items: set[int] = set()  # items and whatever is in them
    for i, (tag, attrs, parent) in enumerate(tree.elements):
        listed, item, link = place[parent] if parent >= 0 else (False, None, None)
        within = parent in in_items
        if tag == "li" and listed:
            item, link = (None if within else i), None
            in_items.add(i)
        elif within:
            in_items.add(i)
        if tag in ("ul", "div") and RESULT_LIST in (attrs.get("class") or "").split():
            listed = True
        if tag == "a" and item is not None and item not in first:
            first[item] = link = i
        place.append((listed, item, link))
    titles: dict[int, list[str]] = {}
    meta: dict[int, list[str]] = {}
    for at, text in tree.texts:
        _, item, link = place[at] if at >= 0 else (False, None, None)
        if item is not None:
            (titles if link is not None else meta).setdefault(item, []).append(text)
    rows = []
    for item, link in first.items():
        row = {"title": "".join(titles.get(item, [])).strip(), "href": (tree.elements[link][1].get("href") or "").strip(), "meta": " ".join(x.strip() for x in meta.get(item, []) if x.strip())}
        if row["title"] and row["href"]:
            rows.append(row)
    return rows


def _list_rows(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(result_rows)
