"""Main text of web pages: parser events, text-to-tag ratio by line, smoothing, and a threshold that picks the content region.

The standard library's parser is fed piece by piece, and its events make lines: a line is the text of one block, with the number of
tags since the line before (Weninger, Hsu and Han, 2010, take the lines of the source; a page may have only one). What the
markup itself calls a menu, header, footer, sidebar, notice, advert, form or comments is out. The ratios of the other lines
are smoothed by a Gaussian, and lines at or above the deviation of the smoothed ratios are content. The region is the smallest element around
nine tenths of the content's text, widened to the article it lies in; all of its lines are the main text, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The parser gets so many characters at a time.
PIECE = 1 << 16
#: Standard deviation of the Gaussian in lines, and what share of the content's text a region holds.
SIGMA = 1.0
SHARE = 0.9

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SPACED = frozenset("br img wbr td th".split()) - {"wbr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("head title script style noscript template svg math object iframe canvas audio video map datalist select option textarea button".split())
APART = frozenset("nav footer aside form dialog menu fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tooltip".split())
#: A start tag of the key ends an open element of the value, if none of the second value stands between.
ENDS = {
    **{t: ({"p"}, {"button", "table", "td", "th", "object"}) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Words in the class or id of an element that says it is no main text, and words that take that back.
NAMES_APART = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead header topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond discussion disqus replies "
    "search searchform form widget widgets pagination pager skip copyright dialog paywall".split()
)
NAMES_COMMENTS = frozenset("comment comments commentlist respond discussion disqus replies".split())
NAMES_OWN = frozenset("with has no without".split())
ARTICLE_NAMES = frozenset("article post entry story".split())
#: Tags that mean something without attributes.
SPECIAL = UNSEEN | APART | {"header", "main", "article"}


def names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id: parted at marks and at capitals."""
    given = [*attrs.get("class", "").split(), attrs.get("id", "")]
    return [re.sub(r"([a-z])([A-Z])", r"\1 \2", g).replace("_", " ").replace("-", " ").lower().split() for g in given if g]


class Element:
    """An open element. What its parent is in, it is in as well.

    out: why its text is out: "" (it is not), "unseen", "tag" or "name"; comments: it holds comments of readers; article: it is an article,
    within: it lies in one; heading: it lies in a heading; block: itself or, for inline elements, the block around.
    """

    __slots__ = ("article", "block", "comments", "depth", "heading", "out", "parent", "tag", "within")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.article = tag, parent, False
        if parent is None:
            self.depth, self.out, self.comments, self.within, self.heading, self.block = 0, "", False, False, False, self
        else:
            self.depth, self.out, self.comments, self.within = parent.depth + 1, parent.out, parent.comments, parent.within
            self.heading = parent.heading or tag in HEADINGS
            self.block = parent.block if tag in INLINE else self

    def path(self) -> Iterator[Element]:
        at: Element | None = self
        while at:
            yield at
            at = at.parent


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    at: Element
    heading: bool
    out: str

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags)


@dataclass(slots=True)
class Open:
    """The line that events are being added to."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0


class Lines(HTMLParser):
    """Lines of a page, from the events of the parser; never fails on broken markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = Element("html", None)
        self.open = Open()
        self.lines: list[Line] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag not in INLINE and tag not in SPACED:
            self.flush()
        self.open.tags += 1
        if tag in SPACED:
            self.open.parts.append(" ")
        if tag not in VOID and tag != "html":
            self.at = self.element(tag, {k: v or "" for k, v in reversed(attrs)}) if attrs or tag in SPECIAL else Element(tag, self.at)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        block = tag not in INLINE
        for e in self.at.path():
            if e.parent is None or not block and e.tag not in INLINE:
                break
            if e.tag == tag:
                if block and tag not in SPACED:
                    self.flush()
                self.at = e.parent
                break
        self.open.tags += 1
        if tag in SPACED:
            self.open.parts.append(" ")

    def handle_data(self, data: str) -> None:
        self.open.parts.append(data)

    def close(self) -> None:
        super().close()
        self.flush()

    def end_open(self, tags: set[str], bounds: set[str]) -> None:
        """Close the outermost open element of tags that is not beyond one of bounds."""
        found = None
        for e in self.at.path():
            if e.tag in bounds or e.parent is None:
                break
            if e.tag in tags:
                found = e
        if found:
            self.flush()
            self.at = found.parent or found

    def element(self, tag: str, given: dict[str, str]) -> Element:
        words, roles = names(given), given.get("role", "").lower().split()
        e = Element(tag, self.at)
        if tag in ("main", "article") or "main" in roles or given.get("itemprop", "").lower() == "articlebody":
            e.article = e.within = True
            own = any(NAMES_COMMENTS.intersection(w) for w in words)
            # An article inside something that was not closed, or only named so, is an article.
            if not own and not e.comments and (e.out == "name" or e.out == "tag" and all(p.tag in ("nav", "form", "header") or p.out != "tag" for p in self.at.path())):
                e.out = ""
            if own and tag == "article":
                e.article, e.within, e.out, e.comments = False, self.at.within, e.out or "name", True
            return e
        if tag in UNSEEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "").lower()):
            e.out = "unseen"
        elif not e.out and (tag in APART or tag == "header" and not e.within or APART_ROLES.intersection(roles)):
            e.out = "tag"
        if tag not in HEADINGS and tag != "body":
            for w in words:
                hit = NAMES_APART.intersection(w)
                if e.within or ARTICLE_NAMES.intersection(w):
                    hit -= {"header"}
                if hit and (not NAMES_OWN.intersection(w) or NAMES_COMMENTS.intersection(w)):
                    e.out = e.out or "name"
                    e.comments |= bool(NAMES_COMMENTS.intersection(w))
        return e

    def flush(self) -> None:
        """End the line; without text its tags go on to the next."""
        if self.open.parts:
            text = " ".join("".join(self.open.parts).split())
            if text:
                self.lines.append(Line(text, self.open.tags, self.at.block, self.at.heading, self.at.out))
                self.open = Open()
            else:
                self.open.parts.clear()


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    return parser.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of `sigma` lines; at the ends over the lines that there are."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    full = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[full] / np.convolve(np.ones(len(ratios)), kernel)[full]


def content(lines: list[Line]) -> np.ndarray:
    """Which lines are content: those whose smoothed ratio is not below the deviation of all; all of them if none is."""
    ratios = smoothed(np.array([line.ratio for line in lines], np.float64))
    found = ratios >= ratios.std()
    return found if found.any() else np.ones(len(lines), bool)


def region(lines: list[Line]) -> Element:
    """The element that holds the main text."""
    # Of each element: characters of content in it, lines in it, and those among them that are content or headings.
    sums: dict[Element, list[int]] = {}
    for line, hit in zip(lines, content(lines).tolist()):
        own = sums.setdefault(line.at, [0, 0, 0])
        own[0] += hit * len(line.text)
        own[1] += 1
        own[2] += hit or line.heading
    open_at: dict[int, set[Element]] = {}
    for e in sums:
        open_at.setdefault(e.depth, set()).add(e)
    total = sum(own[0] for own in sums.values())
    at = None
    for depth in range(max(open_at), -1, -1):
        for e in open_at.get(depth, ()):
            own = sums[e]
            if at is None and own[0] >= SHARE * total:
                at = e
            if e.parent:
                up = sums.setdefault(e.parent, [0, 0, 0])
                for i in range(3):
                    up[i] += own[i]
                open_at.setdefault(depth - 1, set()).add(e.parent)
    around = [e for e in at.path() if e.article]
    if around:
        return around[-1]
    # Headings and content beside it, such as a title over the body, belong to it.
    while at.parent and at.parent.parent and sums[at.parent][1] - sums[at][1] == sums[at.parent][2] - sums[at][2]:
        at = at.parent
    return at


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, joined by empty lines; empty if it has none."""
    lines = lines_of(html or "")
    kept = [line for line in lines if not line.out] or [line for line in lines if line.out == "name" and not line.at.comments]
    if not kept:
        return ""
    at = region(kept)
    inside: dict[Element, bool] = {}
    for line in kept:
        if line.at not in inside:
            inside[line.at] = any(e is at for e in line.at.path())
    return "\n\n".join(line.text for line in kept if inside[line.at])


def extracted(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ident, url, text and n_chars (code points of text) of every page.

    Null and empty pages, and pages without main text, have an empty text and 0; ids may be null or repeat, and an empty table gives an empty table.
    """
    rows = pages.select(pages[f"`{ident}`"].alias("ident"), pages[f"`{url}`"].alias("url"), pages[f"`{html}`"].alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("ident", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["ident", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"ident {kinds['ident']}, url {kinds['url']}, text string, n_chars bigint")
