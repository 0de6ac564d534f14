"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives events; each block of the page becomes a line with its text, its tags and
its place in the tree. Parts that are no content by their element or role are left out as they stream by; forms and those
that a class or id names, at the end of the page, unless they hold most of its text or all that is left. The
text-to-tag ratios of the remaining lines are smoothed along the page and cut at a threshold in two clusters. The
articles, or main, or else the smallest container that holds all of the content cluster are the content region; all its
lines, short ones too, make up the text, with lines outside that are content of themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..workspace import by_size, plain

#: Elements that are blocks, that have no end tag, and that are no content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside button select textarea input iframe object svg canvas menu dialog audio video map search math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words in a class or id that say the element is no content.
WORDS = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promoted promotion banner sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer footnav masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies discussion related recommended recommendations widget pagination pager skip search form copyright legal outbrain taboola".split())
#: Elements that an opening tag of the same kind, or any block, ends.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: Those of the words that as an id are ordinary anchors of an article's parts.
ANCHORS = frozenset("discussion related legal notice notices search form share sharing social skip promotion copyright comment respond reply replies recommended recommendations subscription advertising overlay consent widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be the region; others, as lists, tables and quotes, are parts of one.
CONTAINERS = frozenset("html body article main div center td".split())
#: Elements that an end tag of no block does not reach through.
BARRIERS = frozenset("td th article main nav aside footer form".split())
SIGMA = 1.5
_OPENED = re.compile(r"<(?=[a-zA-Z/!?])")


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    at: int  # the innermost open element


class _Lines(HTMLParser):
    """Collects a line a block, as the events come, in a tree of elements: each has a kind and a parent of a smaller number.

    What an event needs of the open elements is kept at hand (the last block, the last of a name, the last barrier), so
    a page takes time in proportion to its length, however deep it is nested and whatever it leaves open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents, self.out = [""], [0], [False]  # by number; 0 is the page
        self.open = [0]
        self.last: dict[str, list[int]] = {}  # places in open, by name
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.lines: list[_Line] = []
        self.buffer: list[str] = []
        self.tags = self.linked = self.links = 0
        self.named: set[int] = set()  # elements whose kind, class or id says that they are no content

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append(_Line(text, self.tags, self.linked, self.open[-1]))
        self.buffer.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.blocks:
            closed_by = CLOSED_BY.get(self.kinds[self.open[self.blocks[-1]]])
            if closed_by and tag in closed_by:
                self.shut(self.blocks[-1])
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        out = self.out[self.open[-1]] or tag in SKIPPED or (tag == "header" and not (self.last.get("article") or self.last.get("main")))
        named = tag == "form"
        if attrs and not out and tag not in ("html", "body", "article", "main"):
            for key, value in attrs:
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value and value.strip().lower() in ROLES:
                    out = True
                elif key == "class" and value and tag not in HEADINGS and not WORDS.isdisjoint(value.lower().split()):
                    named = True
                elif key == "id" and value and tag not in HEADINGS and value.strip().lower() in WORDS - ANCHORS:
                    named = True
                elif key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    out = True
        n, place = len(self.kinds), len(self.open)
        self.kinds.append(tag)
        self.parents.append(self.open[-1])
        self.out.append(out)
        self.open.append(n)
        self.last.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in BARRIERS:
            self.barriers.append(place)
        if named and not out:
            self.named.add(n)
        self.links += tag == "a"

    def shut(self, place: int) -> None:
        if self.blocks and self.blocks[-1] >= place:
            self.flush()
        for n in self.open[place:]:
            self.last[self.kinds[n]].pop()
            self.links -= self.kinds[n] == "a"
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= place:
                places.pop()
        del self.open[place:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.last.get(tag)
        if places and (tag in BLOCKS or not self.barriers or self.barriers[-1] <= places[-1]):
            self.shut(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.out[self.open[-1]]:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())

    def read(self, html: str) -> None:
        """The whole page. Behind its last `>` no tag can be whole; one that begins there is never ended and is no text."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        rest = _OPENED.search(html, end)
        if html[end:]:
            self.handle_data(unescape(html[end : rest.start() if rest else len(html)]))
        self.flush()

    def below(self, values: np.ndarray) -> np.ndarray:
        """For each element the sum of values over itself and all in it; a parent's number is the smaller one."""
        out = values.copy()
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out

    def inside(self, chosen: set[int]) -> np.ndarray:
        """For each element whether it is one of chosen or in one."""
        out = np.zeros(len(self.kinds), bool)
        for n in range(len(out)):
            out[n] = n in chosen or (n > 0 and out[self.parents[n]])
        return out


def _smooth(x: np.ndarray) -> np.ndarray:
    r = math.ceil(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    """The text of the content region of one whole page, a block a line; empty if there is none."""
    page = _Lines()
    page.read(html or "")
    lines = _unnamed(page) or page.lines
    if not lines:
        return ""
    length = np.array([len(x.text) for x in lines], float)
    ratio = length / np.array([1 + x.tags for x in lines])
    linked = np.array([x.linked for x in lines]) / length
    # a line of links is none of content's; a ratio counts for no more than a long paragraph's
    score = _smooth(np.minimum(ratio, 400.0) * (1 - np.minimum(linked, 1.0)))
    limit = min(float(score.std()), float(score.max()) / 2)
    content = score >= limit
    at = np.array([x.at for x in lines])
    mass = page.below(np.bincount(at[content], length[content], minlength=len(page.kinds)))
    kinds = np.array(page.kinds, object)
    marked = {kind: set(np.flatnonzero((kinds == kind) & (mass > 0)).tolist()) for kind in ("article", "main")}
    inner = {kind: page.inside(own) for kind, own in marked.items()}
    held = {kind: float(length[content & inner[kind][at]].sum()) for kind in marked}
    outermost = [n for n in marked["article"] if not inner["article"][page.parents[n]]]
    whole = bool(held["article"] or held["main"])
    if not whole:
        chosen = {_region(page, at, content)}
    elif held["article"] < 0.8 * held["main"] or len(outermost) == 1 and inner["main"][outermost[0]]:
        chosen = marked["main"]  # what stands beside the one article in main, as its heading, is of it
    else:
        chosen = marked["article"]
    inside = page.inside(chosen)[at]
    # a line outside that is content by its own ratio, not by its neighbours', stays
    alone = content & (np.minimum(ratio, 400.0) >= limit) & (linked < 0.5)
    keep = np.where(inside, whole | content | (linked < 0.5), alone)
    return "\n".join(lines[k].text for k in np.flatnonzero(keep))


def _unnamed(page: _Lines) -> list[_Line]:
    """The lines outside the elements that a kind, class or id names as no content, but for one that holds most of the text."""
    if not page.named or not page.lines:
        return page.lines
    at = np.array([x.at for x in page.lines])
    own = np.array([max(0, len(x.text) - x.linked) for x in page.lines], float)
    mass = page.below(np.bincount(at, own, minlength=len(page.kinds)))
    # an article of its own outside says that the named element, long as it may be, is beside it
    free = ~page.inside(page.named)
    marks = np.array([k in ("article", "main") for k in page.kinds]) & free & (mass > 0)
    whole = page.below(marks.astype(float))
    above = np.zeros(len(page.kinds))
    for n in range(1, len(above)):
        above[n] = above[page.parents[n]] + marks[page.parents[n]]
    beside = {n for n in page.named if whole[0] - whole[n] > above[n]}
    gone = {n for n in page.named if mass[n] and (2 * mass[n] <= mass[0] or n in beside)}
    out = page.inside(gone)
    return [x for x in page.lines if not out[x.at]]


def _region(page: _Lines, at: np.ndarray, content: np.ndarray) -> int:
    """The smallest container that holds all content lines and, if one does short of the body, a title; 0 for the page."""
    n_content = page.below(np.bincount(at[content], minlength=len(page.kinds)).astype(float))
    heads = np.zeros(len(page.kinds))
    for k in set(at.tolist()):
        n = k
        while n and page.kinds[n] not in BLOCKS:
            n = page.parents[n]
        heads[k] = page.kinds[n] == "h1"
    titles = page.below(heads)
    path, n = [0], int(at[np.flatnonzero(content)[0]])
    while n:
        path.append(n)
        n = page.parents[n]
    holders = [n for n in path if n_content[n] == n_content[0] and page.kinds[n] in CONTAINERS]
    titled = [n for n in holders if page.kinds[n] not in ("body", "html") and titles[n]]
    return max(titled or holders, default=0)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (its code points) for each row of pages.

    A null or empty page, or one without content, has the empty text. White space inside a block becomes one space;
    blocks are joined by one line feed, in page order; nothing else is dropped or cut. Rows that repeat come back as
    often. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in by_size(batches, "_html"):
            text = [main_text(h) for h in x["_html"]]
            yield plain(x.drop(columns="_html").assign(text=text, n_chars=[len(t) for t in text]))

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_html").dtypes)
    return rows.mapInPandas(run, f"{kept}, text string, n_chars long")
