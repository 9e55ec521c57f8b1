"""Main text of web pages by text-to-tag ratios.

A page is read once as a stream of parser events. Block elements end lines; each line has its text, the
number of tags in it, how much of it is linked, and the element that holds it. Lines get the ratio of text to
tags, the ratios are smoothed with a Gaussian and clustered in two by a threshold. The content region is the
article that holds the most text of the high cluster, or, where a page has no article, the innermost element
with most of that text. Inside it the text is the run from the first to the last line of the high cluster; lines
of the low cluster before and after that run stay unless they are mostly links.

Lines in elements that are menus, headers, footers, sidebars or forms by tag, role or ``hidden`` are never text.
Class names and ids only suggest that: an element that holds half of the page's high-cluster text is content
whatever its names say. Reader comments are judged by their place instead, as they may well outweigh the article: an
element that its names call a thread, and articles that repeat inside an article, go if plain text came before them in
the page. Of several articles side by side the one with the most text of the high cluster is the page's.

Defined cases: a null or empty page, and one without text, gives an empty string; equal or repeated pages
are extracted alike; broken markup is read as far as a browser would, unknown declarations are comments; elements
that never end hold what follows, and time and memory stay linear in a page's length however deep it nests. An
empty table gives an empty result. Only the id, url and html columns are looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

#: HTML elements by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template svg math iframe object canvas audio video map title head select textarea button "
    "datalist option".split()
)
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(("article", "main"))
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_P_FENCE, _LIST_FENCE = BLOCKS - {"p"}, frozenset(("ul", "ol", "dl", "table"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Parts of class names and ids that suggest boilerplate, and what may stand beside them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup comment comments disqus replies sidebar widget menu nav "
    "navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations footer header "
    "masthead popup modal overlay toolbar pagination pager login copyright".split()
)
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons container content form holder icons inner item items left "
    "links list main message outer panel posts right section site slot stories thread top unit wrap wrapper".split()
)
#: Of these the parts that name a thread of reader comments, and more that only name threads.
THREADS = frozenset("comment comments commentlist disqus replies responses discussion".split())
_NAME_PART = re.compile(r"[^a-z0-9]+")
_NEGATED = frozenset("has no with without is not".split())
SIGMA, REACH = 1.0, 2
_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
DECLARED, SUGGESTED = 2, 1


def _suggests_boilerplate(name: str) -> bool:
    parts = [p for p in _NAME_PART.split(name) if p]
    if not parts or parts[0] in _NEGATED:
        return False
    rest = parts[1:]
    return parts[-1] in HINTS or (parts[0] in HINTS and all(p in BESIDE or p in HINTS or p.isdigit() for p in rest))


def _names_thread(name: str) -> bool:
    parts = [p for p in _NAME_PART.split(name) if p]
    return bool(parts) and parts[0] not in _NEGATED and (
        parts[-1] in THREADS or (parts[0] in THREADS and all(p in BESIDE or p in THREADS or p.isdigit() for p in parts[1:]))
    )


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """DECLARED by tag, role or hiding, SUGGESTED by names, or 0."""
    if tag in BOILERPLATE:
        return DECLARED
    found = 0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return DECLARED
        if not value or tag in ("html", "body"):
            continue
        if name == "role" and value.lower() in ROLES:
            return DECLARED
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return DECLARED
        if (name == "class" or name == "id") and any(map(_suggests_boilerplate, value.lower().split())):
            found = SUGGESTED
    return found


class _Lines(HTMLParser):
    """Lines of a page as (text, tags, linked characters, in a list, element); elements know their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, hidden
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the tag is
        self.fences: dict[frozenset[str], list[int]] = {f: [] for f in (_P_FENCE, _LIST_FENCE)}
        self.hidden = 0
        self.parent, self.doubt = [-1], [0]  # by element number; 0 is the page
        self.containers: list[int] = []
        self.articles: list[int] = []
        self.threads: list[tuple[int, int]] = []  # element, lines before it
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.lines.append((text, self.tags, self.linked, bool(self.open["li"]), self.stack[-1][1] if self.stack else 0))
        if self.parts:
            self.parts = []
        self.tags = self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_html_declaration(self, i: int) -> int:
        # The parser fails on "<![" with an unknown word; to a browser all of these are comments up to ">".
        if self.rawdata.startswith("<![", i):
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES_P:
                self._close("p", _P_FENCE)
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                self._close(tag, _LIST_FENCE)
            if tag == "body":
                self._close("head")
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.hidden:
                self.parts.append(" ")
            return
        number = len(self.parent)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.doubt.append(_boilerplate(tag, attrs) if attrs else DECLARED if tag in BOILERPLATE else 0)
        hidden = tag in HIDDEN
        self.open[tag].append(len(self.stack))
        for fence, places in self.fences.items():
            if tag in fence:
                places.append(len(self.stack))
        self.stack.append((tag, number, hidden))
        self.hidden += hidden
        role = dict(attrs).get("role") if attrs else None
        if tag in CONTAINERS or role in ("main", "article"):
            self.containers.append(number)
        if tag == "article" or role == "article":
            self.articles.append(number)
        if attrs and tag not in ("html", "body") and any(
            name in ("class", "id") and value and any(map(_names_thread, value.lower().split())) for name, value in attrs
        ):
            self.threads.append((number, len(self.lines) + bool(self.parts)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe") and self.stack and self.stack[-1][0] == tag:
            self._pop()

    def _pop(self) -> None:
        tag, _, hidden = self.stack.pop()
        self.open[tag].pop()
        for fence, places in self.fences.items():
            if tag in fence:
                places.pop()
        self.hidden -= hidden

    def _close(self, tag: str, fence: frozenset[str] | None = None) -> None:
        """Close the nearest open ``tag``, and what is open in it, unless an element of the fence is nearer."""
        if not self.open[tag]:
            return
        at = self.open[tag][-1]
        if fence is None or not self.fences[fence] or self.fences[fence][-1] < at:
            while len(self.stack) > at:
                self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len("".join(data.split()))


def _high(lines: list, bad: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lines, none where ``bad``, and whether they are in the high cluster of smoothed ratios."""
    size = np.array([0 if bad[x[4]] else len(x[0]) for x in lines], "f8")
    tags = np.array([x[1] for x in lines], "f8")
    ratio = size / (1 + tags)
    ratio = np.convolve(np.concatenate([ratio[:1].repeat(REACH), ratio, ratio[-1:].repeat(REACH)]), _KERNEL, "valid")
    low, high, n, total, before = float(ratio.min()), float(ratio.max()), len(ratio), float(ratio.sum()), -1
    for _ in range(20):  # two clusters: the threshold is half-way between their means
        above = ratio > (low + high) / 2
        count = int(np.count_nonzero(above))
        if count in (0, n, before):
            break
        upper, before = float(ratio[above].sum()), count
        low, high = (total - upper) / (n - count), upper / count
    return size, (ratio >= (low + high) / 2) & (size > 0)


def _held(parent: list[int], at: list[int], weight: list[float]) -> list[float]:
    """What each element and all in it hold. Elements are numbered after their parents."""
    held = [0.0] * len(parent)
    for number, w in zip(at, weight, strict=True):
        held[number] += w
    for number in range(len(parent) - 1, 0, -1):
        held[parent[number]] += held[number]
    return held


def _inherited(parent: list[int], own: set[int]) -> list[bool]:
    """Whether each element is in ``own`` or inside one of them."""
    out = [False] * len(parent)
    if own:
        out[0] = 0 in own
        for number in range(1, len(parent)):
            out[number] = out[parent[number]] or number in own
    return out


def _threads(reader: _Lines, bad: list[bool]) -> set[int]:
    """Elements with reader comments: named so, or articles that repeat in an article, after plain text of the page."""
    plain = [i for i, (text, _, linked, _, n) in enumerate(reader.lines) if not bad[n] and 2 * linked <= len("".join(text.split()))]
    first = plain[0] if plain else len(reader.lines)
    out = {n for n, before in reader.threads if before > first}
    if len(reader.articles) > 2:
        own, outer = set(reader.articles), [-1] * len(reader.parent)  # the nearest article around each element
        for n in range(1, len(reader.parent)):
            up = reader.parent[n]
            outer[n] = up if up in own else outer[up]
        around = defaultdict(list)
        for n in reader.articles:
            if outer[n] >= 0:
                around[outer[n]].append(n)
        # Elements are numbered in page order, so text of the outer article before the first inner one has a smaller number.
        said = {reader.lines[i][4] for i in plain}
        for holder, inner in around.items():
            if len(inner) > 1 and any(n < inner[0] and (n == holder or outer[n] == holder) for n in said):
                out |= set(inner)
    return out


def _region(reader: _Lines, at: list[int], weight: np.ndarray) -> int:
    """The number of the element that holds the content; 0 for the whole page."""
    held = _held(reader.parent, at, weight.tolist())
    inside = {n: held[n] for n in reader.containers if held[n] > 0}
    if inside:
        most = max(inside.values())
        return min(n for n, w in inside.items() if w >= 0.999 * most)
    count = _held(reader.parent, at, [1.0] * len(at))
    deep = [n for n, w in enumerate(held) if w >= 0.75 * held[0] > 0 and count[n] > 1]
    return max(deep, default=0)


def extract_text(html: str | None) -> str:
    """The main text of one page: its blocks, white space within each turned into one space, one per line."""
    if not html:
        return ""
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and (html[last + 1 : last + 2].isalpha() or html[last + 1 : last + 2] in ("/", "!", "?")):
        html = html[:last]  # a page that was cut off inside a tag
    reader = _Lines()
    reader.feed(html)
    reader.close()
    reader.end_line()
    lines = reader.lines
    if not lines:
        return ""
    at = [x[4] for x in lines]
    declared = {n for n, d in enumerate(reader.doubt) if d == DECLARED}
    suggested = [n for n, d in enumerate(reader.doubt) if d == SUGGESTED]
    bad = _inherited(reader.parent, declared)
    threads = _threads(reader, _inherited(reader.parent, declared | set(suggested)))
    if threads:
        declared |= threads
        bad = _inherited(reader.parent, declared)
    size, high = _high(lines, bad)
    if suggested:
        held = _held(reader.parent, at, np.where(high, size, 0.0).tolist())
        bad = _inherited(reader.parent, declared | {n for n in suggested if 2 * held[n] < held[0]})
        size, high = _high(lines, bad)
    region = _region(reader, at, size * np.where(high, 1.0, 0.1))
    inside = _inherited(reader.parent, {region})
    article = _inherited(reader.parent, set(reader.articles))
    chosen = [i for i, n in enumerate(at) if inside[n] and not bad[n]]
    core = [i for i in chosen if high[i]]
    first, last = (core[0], core[-1]) if core else (0, len(lines))
    out: list[str] = []
    run: list[str] = []
    for i in chosen:
        text, _, linked, in_list, number = lines[i]
        solid = len("".join(text.split()))
        if not first <= i <= last and not in_list and 2 * linked > solid:
            continue
        if in_list and linked >= solid and not (article[number] and any(map(str.isalpha, text))):
            run.append(text)
            continue
        out += run if len(run) < 3 else []  # three links in a row or more are a menu; in an article, only page numbers
        run = []
        out.append(text)
    out += run if len(run) < 3 else []
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [extract_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return chosen.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
