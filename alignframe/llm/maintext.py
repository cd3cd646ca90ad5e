"""The main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering of regions.

The standard library's parser reads a page piece by piece. Its events make lines: one for every stretch of text between two
tags of block elements, so that pages written on one line and pages spread over many are read alike. A line's ratio is the
number of its characters outside links, divided by the number of tags that came with it. The ratios are smoothed by a
Gaussian kernel, and their standard deviation is the threshold that parts content from the rest.

Lines are taken by regions, never one by one, so that a short paragraph stays with its neighbours. A region is what one
element directly holds, lists and tables included; an element with a single line and no blocks of its own is part of its
parent, and a list of links is nobody's. Where a page marks its article, each outermost marked element is a region as a whole
and no other region is considered: ``article`` elements, else ``main``, else what class or id call by such names, if that
holds a quarter of the text. A region is content if the mean of its smoothed ratios, weighted by characters, reaches the
threshold; if none does, the one with the most text is. Headings directly in front of content belong to it.

What the page itself names as menu, header, footer, sidebar, notice, advert, form or reader comments, by element, role, class
or id, is read but never taken, and neither is anything hidden. Names yield to an article inside the named element.

A block's white space, line breaks included, becomes single spaces; blocks are joined by two line feeds. Null and empty pages
give an empty text, and so do pages without any text of their own. Repeated rows stay repeated. Columns of any name pass
unseen. Unclosed and wrongly nested tags are closed as far as the block structure needs it; a page may be of any length.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import small_batches

# Elements of the HTML standard, by what they are to a reader.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNSEEN = frozenset("script style noscript template title iframe object svg canvas audio video map datalist".split())
_BOILERPLATE = frozenset("nav footer aside form button select textarea menu dialog search fieldset".split())
_TELLING = _BOILERPLATE | {"article", "header", "main"}
_LISTS = frozenset("dl menu ol ul".split())
_TABLES = frozenset("table tbody td tfoot th thead tr".split())
_SPACED = frozenset("br td th img wbr".split())
# Elements whose start ends an open one of the same group, within the nearest enclosing list or table.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())
# Elements whose class says how they look rather than what they are.
_PLAIN = frozenset("a b cite code em i li q small span strong td th tr u".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# What authors call the parts of a page that are not its article.
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination popup privacy promo promoted promotion recommended related replies respond "
    "responses search share sharing sidebar signup social sponsor sponsored submenu subscribe toolbar topbar widget widgets".split()
)
_NOT_NAMES = frozenset("has no with without".split())
_MARKS = frozenset("article body content entry main post story text".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNFINISHED = re.compile(r"<[!/?A-Za-z]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_PIECE = 1 << 16
RADIUS = 1.0


def _named(names: str) -> bool:
    """Whether a class or id names a part outside the article: one of its names begins or ends with such a word."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and _NOT_NAMES.isdisjoint(parts) and (parts[0] in _NAMES or parts[-1] in _NAMES):
            return True
    return False


def _marking(names: str) -> bool:
    """Whether a class or id names the article itself, by such words alone."""
    return any((parts := _PARTS.findall(name.lower())) and _MARKS.issuperset(parts) for name in names.split())


class _Element:
    __slots__ = ("blocks", "dropped", "lines", "linked", "marks", "parent", "soft", "tag", "text")

    def __init__(self, tag: str, parent: _Element | None, dropped: bool, soft: bool, marks: tuple[int, int, int]):
        # ``soft``: dropped by itself, in a way that an article inside overrules. ``marks``: numbers of the outermost
        # ``article``, ``main`` and named element around, 0 for none.
        self.tag, self.parent, self.dropped, self.soft, self.marks = tag, parent, dropped, soft, marks
        self.blocks = self.lines = self.text = self.linked = 0


class _Line:
    __slots__ = ("element", "heading", "linked", "taken", "tags", "text")

    def __init__(self, text: str, linked: int, tags: int, element: _Element, heading: bool, taken: bool):
        self.text, self.linked, self.tags, self.element, self.heading, self.taken = text, linked, tags, element, heading, taken

    @property
    def ratio(self) -> float:
        return max(len(self.text) - self.linked, 0) / max(self.tags, 1)


class _Reader(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Element] = [_Element("", None, False, False, (0, 0, 0))]
        self.regions = self.unseen = self.links = self.tags = self.linked = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _SPACED:
            self.parts.append(" ")
        if tag in _BLOCK:
            self._end_line()
        if tag in _ENDS:
            self._close(_ENDS[tag], _SCOPE)
        if tag in _VOID or (tag in ("html", "body") and any(e.tag == tag for e in self.open)):
            return
        top = self.open[-1]
        dropped, soft, marks = top.dropped, False, top.marks
        if attrs or tag in _TELLING:
            own = {k: v or "" for k, v in attrs}
            outside, soft = self._outside(tag, own)
            if dropped and not outside and tag in ("article", "main") and self._all_soft():
                dropped = False
            dropped = dropped or outside
            if not dropped:
                marks = self._marked(tag, own, marks)
        if tag == "a":
            self.links += 1
        if tag in _UNSEEN:
            self.unseen += 1
        if tag in _BLOCK:
            self._block(top)
        self.open.append(_Element(tag, top, dropped, soft, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "path", "object", "iframe"):
            self._close({tag}, frozenset())

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
        elif tag in _SPACED:
            self.parts.append(" ")
        if tag not in ("html", "body"):
            # Text after the end of the body still belongs to the page.
            self._close({tag}, frozenset() if tag in _SCOPE else _SCOPE)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[_Line]:
        if _UNFINISHED.match(self.rawdata):
            # A tag or comment that the page's end cuts off.
            self.rawdata = ""
        self.close()
        self._end_line()
        return self.lines

    def _outside(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        """Whether the element is outside the article by itself, and whether an article inside overrules that."""
        if tag in ("html", "body", "head"):
            return False, False
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
            return True, False
        if tag in ("aside", "footer", "dialog"):
            return True, False
        role = attrs.get("role", "").lower()
        if tag == "main" or role == "main":
            return False, False
        if tag in _BOILERPLATE or tag == "header" or role in _ROLES:
            return True, True
        if tag in _HEADING or tag in _PLAIN:
            # Authors name headings and items by looks.
            return False, False
        return _named(attrs.get("class", "")) or _named(attrs.get("id", "")), True

    def _marked(self, tag: str, attrs: dict[str, str], marks: tuple[int, int, int]) -> tuple[int, int, int]:
        article, main, name = marks
        if tag == "article" and not article:
            article = self.regions = self.regions + 1
        elif (tag == "main" or attrs.get("role") == "main") and not main:
            main = self.regions = self.regions + 1
        elif tag in _BLOCK and not name and (
            "articleBody" in attrs.get("itemprop", "") or _marking(attrs.get("class", "")) or _marking(attrs.get("id", ""))
        ):
            name = self.regions = self.regions + 1
        return article, main, name

    def _all_soft(self) -> bool:
        """Whether nothing around drops an article that opens here."""
        hard = False
        for e in self.open:
            before = e.parent is not None and e.parent.dropped
            hard |= e.dropped and not before and not e.soft
        return not hard and not any(self.open[-1].marks[:2])

    def _block(self, top: _Element) -> None:
        while top is not None:
            top.blocks += 1
            if top.tag in _BLOCK or not top.tag:
                break
            top = top.parent

    def _close(self, tags: set[str], stop: frozenset[str]) -> None:
        """End the innermost open element of these names, and what is open inside it."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                for e in self.open[at:]:
                    self.links -= e.tag == "a"
                    self.unseen -= e.tag in _UNSEEN
                del self.open[at:]
                return
            if tag in stop:
                return

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            element = heading = None
            for e in reversed(self.open):
                heading = heading or e.tag in _HEADING
                if element is None and (e.tag in _BLOCK or not e.tag):
                    element = e
            element.lines += 1
            for e in self.open:
                if e.tag in _LISTS:
                    e.text += len(text)
                    e.linked += self.linked
            top = self.open[-1]
            # A heading in the header of an article is its title.
            title = heading and top.dropped and self._only_header()
            self.lines.append(_Line(text, self.linked, self.tags, element, bool(heading), not top.dropped or title))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _only_header(self) -> bool:
        inside = False
        for e in self.open:
            inside |= any(e.marks[:2])
            before = e.parent is not None and e.parent.dropped
            if e.dropped and not before and not (inside and e.tag == "header"):
                return False
        return inside


def smoothed(ratios: np.ndarray, radius: float = RADIUS) -> np.ndarray:
    """The ratios under a Gaussian kernel cut at two radii; at either end the kernel's inner part alone counts."""
    reach = math.ceil(2 * radius)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * radius**2))
    out = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return out / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def _region(line: _Line) -> _Element | None:
    """The element whose region the line is in; None for one in a list of links."""
    element = line.element
    around: _Element | None = element
    while around is not None:
        if around.tag in _LISTS and 2 * around.linked > around.text:
            return None
        around = around.parent
    while element.parent is not None and (
        element.blocks == 0 and element.lines <= 1 or element.tag not in _SCOPE or element.tag in _LISTS or element.tag in _TABLES
    ):
        element = element.parent
    return element


def _regions(lines: list[_Line]) -> list[list[int]]:
    """The numbers of the lines of each region."""
    taken = [(i, line) for i, line in enumerate(lines) if line.taken]
    size = sum(len(line.text) for _, line in taken)
    for level in range(3):
        regions: dict[object, list[int]] = {}
        for i, line in taken:
            if line.element.marks[level]:
                regions.setdefault(line.element.marks[level], []).append(i)
        if regions and (level < 2 or 4 * sum(len(lines[i].text) for at in regions.values() for i in at) >= size):
            return list(regions.values())
    regions = {}
    for i, line in taken:
        regions.setdefault(_region(line), []).append(i)
    regions.pop(None, None)
    return list(regions.values())


def extract(html: str | None, radius: float = RADIUS) -> str:
    """The main text of one page."""
    reader = _Reader()
    for at in range(0, len(html or ""), _PIECE):
        reader.feed(html[at : at + _PIECE])
    lines = reader.finish()
    regions = _regions(lines)
    if not regions:
        return ""
    smooth = smoothed(np.array([line.ratio for line in lines]), radius)
    threshold = float(smooth.std())
    sizes = [sum(len(lines[i].text) for i in at) for at in regions]
    means = [sum(smooth[i] * len(lines[i].text) for i in at) / size for at, size in zip(regions, sizes, strict=True)]
    chosen = [r for r, mean in enumerate(means) if mean >= threshold] or [max(range(len(regions)), key=sizes.__getitem__)]
    keep = {i for r in chosen for i in regions[r]}
    for i in sorted(keep):
        before = i - 1
        while before >= 0 and before not in keep and lines[before].heading and lines[before].taken:
            keep.add(before)
            before -= 1
    return "\n\n".join(lines[i].text for i in sorted(keep))


def main_text(pages: DataFrame, html: str = "html", radius: float = RADIUS, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``pages`` without the column ``html`` and with ``text`` and ``n_chars``, its length in code points.

    Columns of ``pages`` that bear the names of the new ones are replaced.
    """
    small_batches(pages.sparkSession, 200)

    @F.pandas_udf("string")
    def extracted(htmls: pd.Series) -> pd.Series:
        return pd.Series([extract(h, radius) for h in htmls], dtype=object)

    found = pages.withColumn(text, extracted(F.col(html)))
    return found.withColumn(chars, F.length(text).cast("bigint")).drop(*({html} - {text, chars}))
