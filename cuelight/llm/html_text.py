"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element stands on a line of its own, and what is furniture by its element or
its class stands as blank lines. The text lengths of a few neighbouring lines are summed at every line; where that
curve surges from nothing a region begins, where it dives to nothing the region ends. Text between is kept.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")
FURNITURE = frozenset(
    "nav header footer aside form menu dialog button select option optgroup fieldset legend label input svg math "
    "canvas object audio video head search datalist template noscript iframe".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
MAIN_ROLES = frozenset("main article".split())
#: Words of class and id values (cut at hyphens, underscores and humps) that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar "
    "widget widgets gdpr paywall".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in RAW}


@dataclass(frozen=True)
class Blocks:
    """window: lines summed at a point. surge: the least sum that opens a region where no main element tells.
    gap: blank lines that furniture leaves, more than a window holds. links: the share of link text that makes a
    line furniture outside a main element."""

    window: int = 3
    surge: int = 60
    gap: int = 4
    links: float = 0.6


@dataclass
class _Line:
    text: str
    linked: int
    main: bool
    furniture: bool
    heading: bool = False
    #: "main" or "article" where that element stands in a wrapper which only its class makes furniture
    wrapped: str = ""


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(source)}


def _is_furniture(name: str, attributes: dict[str, str]) -> bool:
    if name in FURNITURE:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        if value and any(w.lower() in FURNITURE_WORDS for w in _WORD.findall(value)):
            return True
    return False


def _named(name: str, attributes: dict[str, str]) -> bool:
    """Whether a furniture element is one by its class or id alone."""
    return not _is_furniture(name, {k: v for k, v in attributes.items() if k not in ("class", "id")})


@dataclass
class _Element:
    """An open element."""

    name: str
    place: int  # rises from element to element
    furniture: bool = False
    main: bool = False
    by_class: bool = False  # furniture by its class alone
    page_main: bool = False
    within_main: bool = False
    closed: bool = False


class _Open:
    """The open elements, with what is asked of them counted, so that no question walks the stack."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.of: dict[str, list[_Element]] = {}
        self.blocks: list[_Element] = []
        self.mains: list[_Element] = []
        self.furniture = self.links = self.headings = self.certain = self.within = self.n_main = 0
        self.place = 0

    def _count(self, e: _Element, by: int) -> None:
        self.furniture += by * e.furniture
        self.certain += by * (e.furniture and not e.by_class)
        self.within += by * (e.furniture and (e.within_main or e.main))
        self.n_main += by * e.main
        self.links += by * (e.name == "a")
        self.headings += by * (e.name in HEADINGS)

    def push(self, e: _Element) -> None:
        self.place += 1
        e.place, e.within_main = self.place, self.n_main > 0
        self.stack.append(e)
        self.of.setdefault(e.name, []).append(e)
        if e.name in BLOCKS:
            self.blocks.append(e)
        if e.main:
            self.mains.append(e)
        self._count(e, 1)

    def top(self) -> str:
        while self.stack and self.stack[-1].closed:
            self.stack.pop()
        return self.stack[-1].name if self.stack else ""

    @staticmethod
    def _last(of: list[_Element]) -> _Element | None:
        while of and of[-1].closed:
            of.pop()
        return of[-1] if of else None

    def innermost(self, name: str) -> _Element | None:
        return self._last(self.of.get(name, []))

    def block_within(self, e: _Element) -> bool:
        last = self._last(self.blocks)
        return last is not None and last.place > e.place

    def close(self, e: _Element) -> None:
        """The element alone; what is open within it stays open."""
        e.closed = True
        self._count(e, -1)

    def close_from(self, e: _Element) -> None:
        """The element and all that is open within it."""
        while self.stack and self.stack[-1].place >= e.place:
            last = self.stack.pop()
            if not last.closed:
                self.close(last)

    def wrapped(self) -> str:
        """What main element overrides the wrappers around it, which only their class makes furniture; empty if there
        is furniture within it, or an element around it that is so by itself."""
        if not self.n_main or not self.furniture or self.certain or self.within:
            return ""
        while self.mains[0].closed:
            self.mains.pop(0)
        return "main" if self.mains[0].page_main else "article"


def lines(source: str) -> list[_Line]:
    """The page's block lines in order; a line end is wherever a block element begins or ends.

    The time is linear in the page's length, whatever its tags.
    """
    out: list[_Line] = []
    held: list[str] = []
    linked = 0
    opened = _Open()

    def end_line() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                wrapped = opened.wrapped()
                furniture = opened.furniture > 0 and wrapped != "main"
                out.append(_Line(text, linked, opened.n_main > 0, furniture, opened.headings > 0, wrapped))
            held.clear()
        linked = 0

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            held.append(source[at:start])
            if opened.links:
                linked += start - at
            at = start
            continue
        found = _TOKEN.match(source, at)
        if found is None:  # a lone <
            held.append("<")
            at += 1
            continue
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                end_line()
            continue
        closing, rest = found[1] or found[4], found[3] or found[6] or ""
        if closing:
            e = opened.innermost(name)
            if name in BLOCKS or name in FURNITURE or (e is not None and e.furniture):
                end_line()
            if e is not None:
                # an inline end tag doesn't close blocks around it
                if name in BLOCKS or not opened.block_within(e):
                    opened.close_from(e)
                else:
                    opened.close(e)
            continue
        if name in RAW:
            end_line()
            if not rest.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else size
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_line()
            else:
                held.append(" ") if name == "img" else None
            continue
        attributes = _attributes(rest) if rest.strip(" /") else {}
        furniture = _is_furniture(name, attributes)
        if name in BLOCKS or furniture:
            end_line()
            if name in BLOCKS and opened.top() == "p":
                opened.close_from(opened.stack[-1])
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and opened.top() == name:
                opened.close_from(opened.stack[-1])
        if rest.endswith("/") and name not in BLOCKS:
            continue
        main = name in ("main", "article") or attributes.get("role", "").lower() in MAIN_ROLES
        page_main = name == "main" or attributes.get("role", "").lower() == "main"
        opened.push(_Element(name, 0, furniture, main, furniture and _named(name, attributes), page_main))
    end_line()
    return out


def main_blocks(page: list[_Line], how: Blocks = Blocks()) -> list[str]:
    """The blocks between each surge of the curve and the dive after it.

    Furniture stands as blank lines; so does what is outside the main element, where the page has one whose own curve
    surges. A line weighs its text outside links, so a list of links makes no surge. Regions between surges belong to
    the text, as do headings right before one; a region within the main element does if half its text is no link.
    """
    inside = [x for x in page if x.main and not x.furniture]
    blocks = _between(page, how, bool(inside))
    return blocks if blocks or not inside else _between(page, how, False)


def _between(page: list[_Line], how: Blocks, has_main: bool) -> list[str]:
    weight: list[int] = []
    text_at: list[int | None] = []
    for k, x in enumerate(page):
        plain = len(x.text) - min(x.linked, len(x.text))
        outside = not x.main if has_main else x.linked > how.links * max(1, len(x.text))
        if x.furniture or outside:
            if weight and weight[-how.gap :] != [0] * how.gap:
                weight += [0] * how.gap
                text_at += [None] * how.gap
        else:
            weight.append(max(1, plain))
            text_at.append(k)
    n = len(weight)
    if not n:
        return []
    own = np.array(weight)
    total = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(n)
    sums = total[np.minimum(at + how.window, n)] - total[at]
    floor = min(how.surge, int(sums.max()))
    # regions: whether the curve rises over the floor before it dives to nothing, and their lines
    regions: list[tuple[bool, list[int]]] = []
    k = 0
    while k < n:
        if own[k] == 0:
            k += 1
            continue
        end = k
        while end < n and sums[end] > 0:
            end += 1
        regions.append((bool(sums[k:end].max() >= floor), [t for t in text_at[k:end] if t is not None]))
        k = end
    surges = [r for r, (surge, _) in enumerate(regions) if surge]
    kept: list[str] = []
    for r, (surge, of) in enumerate(regions):
        between = bool(surges) and surges[0] < r < surges[-1]
        leads = r + 1 < len(regions) and regions[r + 1][0] and all(page[t].heading for t in of)
        told = has_main and 2 * sum(page[t].linked for t in of) <= sum(len(page[t].text) for t in of)
        if surge or between or leads or told:
            kept += [page[t].text for t in of]
    return kept


def main_text(source: str | None, how: Blocks = Blocks()) -> str:
    """The page's main text: white space within a block is one space, blocks are joined by an empty line.

    None, empty pages and pages of furniture alone give the empty string. Lengths have no limit.
    """
    if not source:
        return ""
    page = lines(source)
    kept = main_blocks(page, how)
    if not kept and any(x.wrapped for x in page):
        kept = main_blocks([replace(x, furniture=x.furniture and not x.wrapped) for x in page], how)
    return "\n\n".join(kept)


def main_text_column(column: str | Column, how: Blocks = Blocks()) -> Column:
    """main_text of a string column, never null."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page, how), na_action=None)

    return extract(column)
