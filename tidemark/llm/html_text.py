"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element or line break. Elements that are boilerplate by tag,
role, class or id (menus, headers and footers of the page, sidebars, notices, adverts, forms, reader
comments) become gaps of GAP empty lines (of one inside an article), as do blocks whose name only suggests it (SOFT) if
most of their text is links; scripts, styles and comments vanish. Every line has a weight: its characters outside links. On a page that
marks its article, each line inside gets BONUS more, less than any threshold, and those outside weigh an eighth; a gap stands where
the article begins and ends. The marks are article, main and role=main, or else
the container of a content class that holds the heaviest line of the page's peak window; neither is believed where more text
lies outside than inside.

Over windows of K lines the weights are summed. Text surges where a sum is above MARGIN (or a fifth of the page's peak if that is less)
and dives where a sum is nothing. What stands between two dives is kept if it surges, from its first to its last line of weight, so short lines beside long
ones stay and short ones alone go, marked or not. Kept lines are joined by newlines.

Defined cases: null or empty html gives an empty text; a page without text gives an empty text; tags that
are never closed end with their parent, and media elements that are never closed (or opened again first) hold nothing; damaged tags and references are read as a browser does; texts are
whole, however long, and take time in proportion; repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Lines per window, the sum above which text surges, what a line's mark adds, and the empty lines of a piece of boilerplate.
K, MARGIN, BONUS, GAP = 3, 86, 43, 3
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
FALLBACK = frozenset("noscript template iframe svg canvas audio video".split())
DROPPED = frozenset("nav aside footer form button select dialog menu head fieldset label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
# Words in class, id and role names that mark what is no article, and what is one.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adunit sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside masthead footer pagination pager skip toolbar topbar bottombar comment comments commentlist disqus reply replies respond responses"
    " login searchbox widget widgets form complementary contentinfo disclaimer".split()
)
SOFT = frozenset("related recommended recommendations trending share sharing social discussion search alert".split())
HEADING = frozenset("header head".split())
CONTENT = frozenset("article articlebody content entry main post postbody story".split())


def _marks(attributes: str) -> set[str]:
    marks: set[str] = set()
    for _, value in ATTRIBUTE.findall(attributes):
        whole = value.strip("\"'")
        marks.update(x.lower() for x in TOKEN.findall(whole))
        marks.update(x.lower() for x in re.split(r"[\s_-]+", whole) if x)
    return marks


def _main_role(attributes: str) -> bool:
    return any(k.lower() == "role" and v.strip("\"'").lower() in ("main", "article") for k, v in ATTRIBUTE.findall(attributes))


class Element(NamedTuple):
    """An open element."""

    name: str
    bad: bool  # boilerplate
    good: bool  # a marked article
    content: bool  # of a content class
    start: int  # its first line
    soft: bool  # its name only suggests boilerplate


class Reader:
    """A page's lines: (text, characters outside links, inside a marked article); `containers`: first line and end of each container of a content class."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, bool]] = []
        self.containers: list[tuple[int, int]] = []
        self._upto = [(0, 0)]  # sums of characters outside links, and of all, before each line
        self._stack: list[Element] = []
        self._blocks: list[int] = []  # where block elements stand in the stack
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._own = self._links = self._boiler = self._article = self._inside = 0
        self._read(html)
        self._pop(0)
        self._end()

    def _put(self, text: str, own: int) -> None:
        self.lines.append((text, own, self._article > 0 and bool(text)))
        a, b = self._upto[-1]
        self._upto.append((a + own, b + len("".join(text.split()))))

    def _end(self) -> None:
        """The line that is being read ends."""
        line = " ".join("".join(self._text).split())
        self._text.clear()
        if line:
            self._put(line, self._own)
        self._own = 0

    def _gap(self) -> None:
        for _ in range(1 if self._article or self._inside else GAP):
            self._put("", 0)

    def _push(self, e: Element) -> None:
        if e.name in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(e)
        self._open[e.name] += 1
        self._boiler += e.bad
        self._article += e.good
        self._inside += e.content
        self._links += e.name == "a"

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            e = self._stack.pop()
            self._open[e.name] -= 1
            if e.name in BLOCK:
                self._blocks.pop()
            if e.name in BLOCK or e.bad or e.good or e.content:
                self._end()
            self._boiler -= e.bad
            self._article -= e.good
            self._inside -= e.content
            self._links -= e.name == "a"
            if e.content:
                self.containers.append((e.start, len(self.lines)))
            if e.soft:
                (a, b), (c, d) = self._upto[e.start], self._upto[-1]
                if 2 * (c - a) < d - b:  # most of it is links
                    del self.lines[e.start :], self._upto[e.start + 1 :]
                    while self.containers and self.containers[-1][0] >= e.start:
                        self.containers.pop()
                    self._gap()
            elif e.bad:
                self._gap()

    def _read(self, html: str) -> None:
        at, closes = 0, {}
        while True:
            m = TAG.search(html, at)
            raw = html[at : m.start()] if m else html[at:]
            if raw and not self._boiler:
                piece = entities.unescape(raw) if "&" in raw else raw
                self._text.append(piece)
                if not self._links:
                    self._own += len("".join(piece.split()))
            if not m:
                return
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
            elif name in RAW or name in FALLBACK:
                at = self._skipped(html, at, name, m[3] or m[6] or "", closes)
            else:
                self._start(name, m[3] or m[6] or "")

    def _close(self, name: str) -> None:
        if not self._open[name]:
            if name in BLOCK and not self._boiler:
                self._end()
            return
        i = len(self._stack) - 1
        while self._stack[i].name != name:
            i -= 1
        self._pop(i)

    @staticmethod
    def _skipped(html: str, at: int, name: str, given: str, closes: dict[str, tuple[int, int]]) -> int:
        """Where reading goes on after an element whose content is no text. closes: the next closing tag found of each name."""
        if given.endswith("/") and name == "svg":
            return at
        start, end = closes.get(name, (-1, -1))
        if start < at:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            start, end = closes[name] = (close.start(), close.end()) if close else (len(html), len(html))
        if name in FALLBACK and (start == len(html) or name != "svg" and re.compile(rf"<{re.escape(name)}[\s/>]", re.I).search(html, at, start)):
            return at  # never closed, or not before the next one: it holds nothing
        return end

    def _start(self, name: str, given: str) -> None:
        if name in BLOCK:
            # an open paragraph or item ends where the next block begins
            if self._blocks and (top := self._stack[self._blocks[-1]].name) and (top == "p" and name != "br" or top == name == "li"):
                self._pop(self._blocks[-1])
            if not self._boiler:
                self._end()
        if name in VOID:
            return
        marks = _marks(given) if "=" in given else set()
        good = name in ("article", "main") or bool(marks & CONTENT) and _main_role(given)
        content = not good and bool(marks & CONTENT)
        bad = name in DROPPED or bool(marks & BOILER) and not (name in ("article", "main", "body", "html") and not marks & {"comment", "comments", "ad", "ads", "advert", "advertisement", "sponsored", "promo"})
        bad = bad or (name == "header" or bool(marks & HEADING)) and not self._article and not self._inside
        usable = not bad and name not in ("body", "html")
        soft = not bad and not self._boiler and name in BLOCK and bool(marks & SOFT) and name not in ("article", "main", "body", "html")
        if (bad or usable and (good or content)) and not self._boiler:
            self._end()
        self._push(Element(name, bad, good and usable, content and usable, len(self.lines), soft))


def _marked(page: Reader, k: int) -> list[bool] | None:
    """Which lines lie in the page's marked article; None without a mark that can be believed."""
    owns = [x[1] for x in page.lines]
    by_tag = [x[2] for x in page.lines]
    if any(by_tag):
        inside = by_tag
    else:
        sums = window_sums(owns, k)
        peak = sums.index(max(sums)) if sums else 0
        heaviest = max(range(peak, min(peak + k, len(owns))), key=owns.__getitem__, default=0)
        holders = [(a, b) for a, b in page.containers if a <= heaviest < b]
        if not holders:
            return None
        a, b = min(holders)[0], max(b for _, b in holders)
        inside = [a <= i < b for i in range(len(owns))]
    return inside if 2 * sum(w for w, good in zip(owns, inside, strict=True) if good) >= sum(owns) else None


def window_sums(weights: list[int], k: int) -> list[int]:
    """Sums of the k weights from each line on."""
    sums, total = [], sum(weights[:k])
    for i, w in enumerate(weights):
        sums.append(total)
        total += (weights[i + k] if i + k < len(weights) else 0) - w
    return sums


def weighted_lines(page: Reader, k: int) -> list[tuple[str, int]]:
    """Lines with their weights, with gaps where the marked article begins and ends."""
    inside = _marked(page, k)
    if inside is None:
        return [(x[0], x[1]) for x in page.lines]
    out: list[tuple[str, int]] = []
    was = False
    for (text, own, _), good in zip(page.lines, inside, strict=True):
        if text:
            if good != was:
                out += [("", 0)] * k
                was = good
            out.append((text, own + BONUS if good else own // 8))
        else:
            out.append((text, 0))
    return out


def main_text(html: str | None, k: int = K, margin: int = MARGIN) -> str:
    """The page's main text."""
    if not html:
        return ""
    lines = weighted_lines(Reader(html), k)
    weights = [w for _, w in lines]
    sums = window_sums(weights, k)
    threshold = min(margin, max(sums, default=0) / 5)
    kept: list[str] = []
    i = 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        first, surges = i, False
        while i < len(lines) and sums[i]:  # up to the dive
            surges |= sums[i] > threshold
            i += 1
        if surges:
            last = i - 1
            while not weights[first]:
                first += 1
            while not weights[last]:
                last -= 1
            kept += [text for text, _ in lines[first : last + 1] if text]
    return "\n".join(kept)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Each page's kept columns with text and n_chars, its code points."""
    columns = [F.col(c) for c in keep]
    fields = [f for c in keep for f in pages.schema.fields if f.name == c]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string", "n_chars long"])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, n):
            texts = [main_text(x.as_py()) for x in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*columns, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
