"""Main text of web pages from streamed parser events.

The standard library's parser streams tags and text; block tags end lines. Each line
has a text-to-tag ratio, nothing where it stands in a menu, header, footer, sidebar, notice, advert, form
or among reader comments, less where its text is links. Ratios are smoothed by a Gaussian over
neighbouring lines and split into two clusters at a threshold; the high cluster marks
content, and the innermost element that holds all marked text is the content region; where that lies in an
article, or else in a main element, this is the region. All its lines that are not boilerplate are kept, short ones too,
but for rows of links outside articles.

Tags, roles and classes that speak for boilerplate are only evidence: a wrapper that holds most of the page's text, or
its largest article, is none, nor is a form round the page or a menu that was never closed.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import slices

#: Tags that end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold others; their nesting is followed.
HOLDERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6".split()) | frozenset("script style noscript template svg math button select textarea iframe object canvas audio video datalist".split())
#: Elements whose text is never content, and those that are boilerplate unless nearly all of the page is in them.
SILENT = frozenset("head title script style noscript template svg math button select textarea iframe object canvas audio video datalist".split())
DROPPED = frozenset("nav footer aside dialog menu search".split())
#: Elements that are boilerplate unless they hold most of the page; marks that stay so even then.
FORMS = frozenset("form fieldset".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Words in class, id or role that mark boilerplate, and values of role.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations widget widgets pagination pager skip login search legal copyright disclaimer form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar status note toolbar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "body": {"html"}}
_TAIL = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


class _Element:
    """``sign``: 0 for content, else the part of the page's text that the element must hold to be content nevertheless (over 1: never)."""

    __slots__ = ("tag", "parent", "sign", "silent", "dropped", "mass", "plain", "story")

    def __init__(self, tag: str, parent: _Element | None, sign: float, silent: bool) -> None:
        self.tag, self.parent, self.sign, self.silent = tag, parent, sign, silent
        self.dropped, self.mass, self.plain, self.story = False, 0.0, 0, False


class _Line:
    __slots__ = ("text", "tags", "linked", "links", "element", "heading")

    def __init__(self, text: str, tags: int, linked: int, links: int, element: _Element, heading: bool) -> None:
        self.text, self.tags, self.linked, self.links, self.element, self.heading = text, tags, linked, links, element, heading


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.now = _Element("", None, 0, False)
        self.elements: list[_Element] = []
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.in_link = 0
        self.heading = False

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(_Line(text, self.tags, self.linked, self.links, self.now, self.heading))
        self.parts.clear()
        self.tags = self.linked = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag in _CLOSED_BY:
            at, stop, close = self.now, _SCOPES[tag], None
            while at.parent is not None and at.tag not in stop:
                if at.tag in _CLOSED_BY[tag]:
                    close = at
                at = at.parent
            if close is not None:
                self.now = close.parent
        if tag in BLOCKS and self.now.tag in ("button", "select", "textarea"):  # never closed: they hold no blocks
            self.now = self.now.parent
        if tag in ("article", "main"):
            self.leave("nav", "button", "menu")
        self.tags += 1
        if tag in HOLDERS:
            self.now = _Element(tag, self.now, self.sign(tag, attrs), self.now.silent or tag in SILENT)
            self.elements.append(self.now)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = True
        elif tag == "a":
            self.in_link = 1
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("script", "style", "iframe", "svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in HOLDERS:
            at = self.now
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None and at.parent is not None:
                self.now = at.parent
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = False
        elif tag == "a":
            self.in_link = 0

    def handle_data(self, data: str) -> None:
        if self.now.silent:  # a script or a button inside a line
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data.strip())

    def leave(self, *tags: str) -> None:
        """Close what stands open of ``tags``."""
        at = self.now
        while at.parent is not None:
            if at.tag in tags:
                self.now = at.parent
            at = at.parent

    def sign(self, tag: str, attrs: list) -> float:
        if tag in DROPPED or tag == "header" and not self.inside("article", "main"):
            return 0.8
        if tag in ("html", "body", "article", "main"):
            return 0
        sign = 0.5 if tag in FORMS else 0.0
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id"):
                found = MARKS.intersection(re.split(r"[\s_\-:]+", value))
                sign = max(sign, 2.0 if found & COMMENTS else 0.5 if found else 0.0)
            elif name == "role" and value.strip() in ROLES:
                sign = max(sign, 0.8)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                sign = 2.0
        return sign

    def weigh(self) -> None:
        """Decide which elements are boilerplate, when all text is known."""
        total = 0
        for line in self.lines:
            n, at = max(0, len(line.text) - line.linked), line.element
            total += n
            while at is not None:
                at.plain += n
                at = at.parent
        at = max((e for e in self.elements if e.tag in ("article", "main") and e.plain), key=lambda e: e.plain, default=None)
        while at is not None:
            at.story, at = True, at.parent
        for e in self.elements:  # parents come first
            most = e.plain >= e.sign * total > 0
            e.dropped = e.parent.dropped or e.sign > 0 and not (e.sign < 1 and (most or e.sign < 0.8 and e.story))

    def inside(self, *tags: str) -> bool:
        at = self.now
        while at is not None:
            if at.tag in tags:
                return True
            at = at.parent
        return False


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbours; weights are renewed at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - reach), min(len(ratios), i + reach + 1))
        out.append(sum(ratios[j] * weight[abs(i - j)] for j in near) / sum(weight[abs(i - j)] for j in near))
    return out


def threshold(values: list[float]) -> float:
    """The middle of the two means that split the values best (one-dimensional 2-means), or 0 where all are alike."""
    low, high = min(values), max(values)
    if low == high:
        return 0.0
    for _ in range(50):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(under) / len(under), sum(over) / len(over))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, hold: float = 1.0) -> str:
    """The main text of one page, blocks joined by newlines; '' for null, empty or contentless pages.

    ``hold``: the part of all marked text that the content region must hold.
    """
    if not html:
        return ""
    events = _Events()
    events.feed(_TAIL.sub("", html))
    events.close()
    events.end_line()
    lines = events.lines
    if not lines:
        return ""
    events.weigh()
    ratios = [0.0 if x.element.dropped else max(0.0, len(x.text) - 1.0 * x.linked) / (1 + x.tags) for x in lines]
    smooth = smoothed(ratios)
    cut = threshold(smooth)
    total = 0.0
    for line, ratio, value in zip(lines, ratios, smooth):
        if value >= cut and ratio > 0:
            total += len(line.text)
            at = line.element
            while at is not None:
                at.mass += len(line.text)
                at = at.parent
    kept = [x for x in lines if not x.element.dropped]
    if total:
        region = max((x.element for x, v, r in zip(lines, smooth, ratios) if v >= cut and r > 0), key=lambda e: e.mass)
        while region.parent is not None and region.mass < hold * total:
            region = region.parent
        at, whole = region, None
        while at is not None:  # the article around the region, else the main part
            if at.tag == "article" or at.tag == "main" and whole is None:
                whole = at
            at = at.parent
        region = whole or region

        def within(e: _Element | None) -> bool:
            while e is not None:
                if e is region:
                    return True
                e = e.parent
            return False

        kept = [x for x in kept if within(x.element) and (x.heading or not _in_header(x.element, region))]
        if whole is None:
            kept = _without_link_rows(kept)
    else:
        kept = _without_link_rows(kept)
    return "\n".join(x.text for x in kept)


def _without_link_rows(lines: list[_Line]) -> list[_Line]:
    """The lines without those that are rows of links, or one link beside others: a single linked line may be text."""
    link = [False, *(x.linked >= 0.7 * len(x.text) and not x.heading for x in lines), False]
    return [x for i, x in enumerate(lines, 1) if not (link[i] and (x.links > 1 or link[i - 1] or link[i + 1] or len(lines) == 1))]


def _in_header(e: _Element | None, region: _Element) -> bool:
    """Whether an article's own header holds the element: only its headings are text."""
    while e is not None and e is not region:
        if e.tag == "header":
            return True
        e = e.parent
    return False


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: ``page_id, url, text, n_chars`` (code points of text).

    A null or empty html gives an empty text. Null ids and urls stay null; repeated rows give a row each;
    very long pages are read whole; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
