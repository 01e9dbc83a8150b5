"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the log odds of being main text, by the elements
around it, the words of their names (class, id, role) and whether its block is all links; a tag scores
the log probability of standing in main text, which is never positive. The weights are
log odds over labelled pages. One linear scan finds the contiguous region of the highest
sum; of its blocks those stay whose own words score above zero, so that an advert or a comment inside
the region goes.

Pages are read row by row inside Arrow batches: no shuffle, and a very long page costs its own size
only. Reading is linear in the page's length.

Defined results: a null or empty page, and one without main text, give an empty text; scripts, styles,
templates, hidden elements and form fields never count; unclosed and badly nested elements, comments and quotes end
where HTML's rules or the page end; character references are decoded; repeated rows give the same;
an empty table gives no rows; other columns pass through, an output replaces a column that has its name.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.llm.common import fresh, named, slices
from sievegrid.llm.labelled_pages import PAGES

#: Elements that end the block before them and after them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is plain text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content readers do not read as text.
UNREAD = frozenset("head noscript template svg math object select button canvas video audio map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the given kind ends, up to the element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What an end tag does not reach through.
WALLS = frozenset("html body table td th article main section aside nav footer header form".split())
#: Elements made to hold a main text; where a page has one, what stands outside is told apart.
HOLDERS = frozenset(["article", "main"])
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
#: What evidence for main text counts at most, and what a word counts at least where nothing is around it.
MOST_FOR, LEAST_WORD = 1.0, 0.2
#: Share of a tag's log probability that counts: each is there twice, and the words around it tell the same.
TAG_SHARE = 0.2
#: Deeper elements are not told apart from their parents.
DEPTH = 512
#: Elements that say nothing about what they hold.
SILENT = frozenset("html body div center".split())
#: A form with so large a share of the page's words is the page itself.
WHOLE_FORM = 0.6
#: Letters of a name's word that count, so that "comment" and "comments" are one.
STEM = 5

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_STOP = re.compile("[>\"']")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NOTHING: frozenset[str] = frozenset()


@dataclass(slots=True)
class Block:
    """Words between two block boundaries, and what stands around them."""

    holder: str
    around: frozenset[str]
    text: str
    n_words: int
    n_linked: int
    kept: bool

    def inside(self) -> bool:
        return not self.around.isdisjoint(HOLDERS)

    def linked(self) -> bool:
        """One link, or links side by side, and no paragraph or heading: more often a menu than a sentence."""
        return self.n_linked * 5 >= self.n_words * 3 and self.holder not in SENTENCES


@dataclass(slots=True)
class Tag:
    name: str
    kept: bool


def _tag_end(page: str, at: int, quotes: dict[str, bool]) -> int:
    """The place of the > that ends the tag; quotes remembers those that the rest of the page lacks."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return len(page)
        i, mark = m.start(), m[0]
        if mark == ">":
            return i
        at = i + 1
        if page[i - 1] in "= \t\n\r" and quotes[mark]:
            close = page.find(mark, at)
            quotes[mark] = close >= 0
            if close >= 0:
                at = close + 1


@functools.lru_cache(4096)
def _named(names: str) -> frozenset[str]:
    return frozenset("." + p.lower()[:STEM] for p in _PIECE.findall(names))


def _attributes(name: str, body: str) -> tuple[frozenset[str], bool]:
    """The words of an element's names, and whether it is hidden."""
    names, hidden = "", False
    if body and not body.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(body):
            key = key.lower()
            if key in ("class", "id", "role"):
                names += " " + (a or b or c)
            elif key == "hidden" or (key == "style" and _UNSEEN.search(a or b or c)):
                hidden = True
    return (_NOTHING if name in ("html", "body") or not names else _named(names)), hidden


def sequence(page: str) -> Iterator[Block | Tag]:
    """The page's tags of blocks and its blocks of words, in order."""
    stack: list[tuple[str, frozenset[str], bool]] = []  # name, features of it and what it is in, unread
    open_: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    holder, around, kept, links = "", _NOTHING, False, 0
    quotes = {'"': True, "'": True}

    def block() -> Iterator[Block]:
        nonlocal pieces
        if pieces:
            words = html.unescape("".join(t for t, _ in pieces)).split()
            if words:
                linked = sum(len(html.unescape(t).split()) for t, inside in pieces if inside)
                yield Block(holder, around, " ".join(words), len(words), min(linked, len(words)), kept)
            pieces = []

    def last_block() -> str:
        return next((name for name, _, _ in reversed(stack) if name in BLOCKS), "")

    def close(n: int) -> None:
        nonlocal links
        for name, _, _ in stack[n:]:
            open_[name] -= 1
            links -= name == "a"
        del stack[n:]

    def end_within(names: set[str], walls: Iterable[str]) -> None:
        """Close the outermost open element of these names inside the nearest wall."""
        at = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                at = i
            elif stack[i][0] in walls:
                break
        if at is not None:
            close(at)

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        lt = len(page) if lt < 0 else lt
        if lt > at:
            if not (stack and stack[-1][2]):
                if not pieces:
                    holder, around = last_block(), stack[-1][1] if stack else _NOTHING
                pieces.append((page[at:lt], links > 0))
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            what = page[at + 4 : end] if end >= 0 else ""
            if what in ("keep", "skip"):
                yield from block()
                kept = what == "keep"
            at = end + 3 if end >= 0 else len(page)
            continue
        closing = page.startswith("</", at)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            else:
                if not (stack and stack[-1][2]):
                    if not pieces:
                        holder, around = last_block(), stack[-1][1] if stack else _NOTHING
                    pieces.append(("<", links > 0))
                at += 1
            continue
        name = m[0].lower()
        end = _tag_end(page, m.end(), quotes)
        body = page[m.end() : end]
        at = end + 1
        is_block = name in BLOCKS
        if is_block:
            yield from block()
            yield Tag(name, kept)
        if closing:
            if open_[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in (WALLS if is_block else BLOCKS) and name not in WALLS:
                        break
            continue
        if name in RAW:
            m = _END[name].search(page, at)
            at = _tag_end(page, m.end(), quotes) + 1 if m else len(page)
            continue
        if name in VOID:
            if name == "br":
                pieces.append((" ", False)) if pieces else None
            continue
        if is_block and open_["p"]:
            end_within({"p"}, BLOCKS - {"p"})
        if name in ENDS:
            end_within(*ENDS[name])
        if len(stack) < DEPTH and not (body.endswith("/") and not is_block and name != "a"):
            outer, unread = (stack[-1][1], stack[-1][2]) if stack else (_NOTHING, False)
            names, hidden = _attributes(name, body)
            own = names | {name} if is_block and name not in SILENT else names
            stack.append((name, outer | own if own - outer else outer, unread or hidden or name in UNREAD))
            open_[name] += 1
            links += name == "a"
    yield from block()


@dataclass(frozen=True)
class Weights:
    """Log odds of words by what is around them, and log probabilities of tags."""

    word: float
    around: dict[str, float]
    linked: float
    outside: float
    tag: float
    tags: dict[str, float]

    def of_word(self, block: Block, held: bool) -> float:
        """The strongest evidence against and, up to MOST_FOR, the strongest for: one sidebar around the text outweighs any names inside it."""
        known = [self.around.get(name, 0.0) for name in block.around]
        odds = self.word + min(known, default=0.0) * (min(known, default=0.0) < 0) + min(max(known, default=0.0), MOST_FOR) * (max(known, default=0.0) > 0)
        return odds + self.linked * block.linked() + self.outside * (held and not block.inside())

    def of_tag(self, name: str) -> float:
        return TAG_SHARE * self.tags.get(name, self.tag)


def read(page: str) -> tuple[list[Block | Tag], bool]:
    """The page's sequence, and whether some words stand in an element made for main text."""
    items = list(sequence(page))
    blocks = [x for x in items if isinstance(x, Block)]
    in_forms = [x for x in blocks if "form" in x.around]
    if in_forms and sum(x.n_words for x in in_forms) >= WHOLE_FORM * sum(x.n_words for x in blocks):
        for x in in_forms:
            x.around -= {"form"}
    return items, any(x.inside() for x in blocks)


def fit(pages: Iterable[str], heft: float = 10.0, prior: float = 0.5) -> Weights:
    """Weights from the words and tags of labelled pages, a block's words counting ``heft`` to one.

    The pages are few; this runs on the driver in well under a second.
    """
    words: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    tags: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for page in pages:
        items, held = read(page)
        for item in items:
            if isinstance(item, Tag):
                for name in ("tag", item.name):
                    tags[name][item.kept] += 1
                continue
            marks = ["linked"] * item.linked() + ["outside"] * (held and not item.inside())
            for name in ("word", *item.around, *(f"+{m}" for m in marks)):
                words[name][item.kept] += item.n_words / heft
    odds = {name: math.log((kept + prior) / (other + prior)) for name, (other, kept) in words.items()}
    base = odds.pop("word")
    known = {name: math.log((kept + prior) / (kept + other + 2 * prior)) for name, (other, kept) in tags.items()}
    linked, outside = (odds.pop(m, base) - base for m in ("+linked", "+outside"))
    return Weights(max(base, LEAST_WORD), {name: x - base for name, x in odds.items()}, linked, outside, known.pop("tag"), known)


@functools.cache
def own_weights() -> Weights:
    """The weights of the labelled pages that come with this module."""
    return fit(PAGES)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest sum: the first of equals; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_blocks(page: str | None, weights: Weights) -> list[str]:
    """The blocks of the page's main text, in order."""
    items, held = read(page or "")
    known: dict[tuple[frozenset[str], bool] | str, float] = {}
    words: list[float] = []
    scores: list[float] = []
    for item in items:
        key = (item.around, item.linked()) if isinstance(item, Block) else item.name
        odds = known.get(key)
        if odds is None:
            odds = weights.of_word(item, held) if isinstance(item, Block) else weights.of_tag(item.name)
            known[key] = odds
        words.append(odds)
        # Words that are no main text go in any case: their block parts a region as one word would.
        scores.append(odds * item.n_words if isinstance(item, Block) and odds > 0 else odds)
    start, stop = best_region(scores)
    return [item.text for item, odds in zip(items[start:stop], words[start:stop], strict=True) if isinstance(item, Block) and odds > 0]


def main_texts(df: DataFrame, html_col: str = "html", out: str = "text", weights: Weights | None = None) -> DataFrame:
    """df with its pages' main texts: blocks in page order, joined by one line feed.

    weights: of the labelled pages of this module unless others were fitted.
    """
    known = weights or own_weights()
    body, whole, text = fresh(df, "page_body"), fresh(df, "page_row"), fresh(df, "page_text")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            texts = ["\n".join(main_blocks(page, known)) for page in batch.column(body).to_pylist()]
            yield pa.record_batch([batch.column(whole), pa.array(texts, pa.string())], [whole, text])

    others = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(F.struct(*[named(c) for c in others]).alias(whole), named(html_col).alias(body))
    kept = rows.mapInArrow(extracted, T.StructType([rows.schema[whole], T.StructField(text, T.StringType())]))
    return kept.select(f"{whole}.*", F.col(text).alias(out))
