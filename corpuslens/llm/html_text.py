"""Main text of web pages.

The standard library's parser streams events; they are folded into block lines, each
with its text, its number of tags, its link characters and the container around it.
Scripts, styles and other elements that are no text at all give no lines. A line's
text-to-tag ratio is its text outside links by its tags; what the markup says is a
feature that scales it: a part whose element, class, id or role names a menu, header,
footer, sidebar, notice, advert, form or comments has none, one inside an article-like
element has more. Ratios are smoothed with a Gaussian and parted in two clusters by a
threshold; lines of the upper one vote, by their text, for the containers around them.
The region is the deepest container that holds nearly all votes, widened to an
article-like element around it and to headings that stand alone before it. Inside the
region every container whose own ratio reaches the threshold or that nothing speaks
against stays whole: no line of the text is dropped for being short.

Defined cases: a null or empty page has an empty text; a page without any container is
read as a whole; of containers with equal votes the deeper, then the earlier one is
taken; unclosed elements end with their parent; very long pages are read whole; repeated
rows are read each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Element names. Those skipped hold no text; those of parts hold text that is not the page's own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas math audio video map head title button select textarea option datalist input".split())
PARTS = frozenset("nav footer aside form dialog menu menuitem fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td table blockquote header ul ol dl p pre figure hgroup".split()) | PARTS
#: Containers that a region may be; others only belong to one.
REGIONS = frozenset("article main section div body td table blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of a class, id or role that mark a part as no main text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices alert overlay pager pagination popup promo promoted promotion recommended related replies "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets banners sidenav topbar".split()
)
ARTICLE_WORDS = frozenset("article articlebody main content post entry story".split())
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Radius of the smoothing window, the share of votes that a container needs, and what the markup makes of a ratio.
SIGMA, MOST = 1.0, 0.85
#: Lines of nothing but links that make a container a menu.
MENU = 3
IN_PART, IN_ARTICLE = 0.0, 2.0


def _names(attrs: dict[str, str | None]) -> set[str]:
    found: set[str] = set()
    for key in ("class", "id", "role", "itemprop"):
        if value := attrs.get(key):
            found.update(_PART.split(_CAMEL.sub("-", value).lower()))
    return found


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, skipped, container number
        self.parents, self.article, self.part, self.region = [-1], [False], [False], [True]  # of each container
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, link characters, container, heading
        self.parts: list[str] = []
        self.tags, self.links, self.in_link, self.at = 0, 0, 0, 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.links, self.at, bool(self.stack) and self.stack[-1][0] in HEADINGS))
            self.tags = 0
        self.parts, self.links = [], 0

    def _pop_to(self, index: int) -> None:
        for tag, _, _ in self.stack[index:]:
            if tag == "a":
                self.in_link = max(0, self.in_link - 1)
        del self.stack[index:]
        self.at = self.stack[-1][2] if self.stack else 0

    def _close_open(self, tags: tuple[str, ...], within: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self._pop_to(i)
                return
            if self.stack[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self._close_open(("p",), CONTAINERS | {"li", "td", "th"})
        if tag in SAME_CLOSES:
            self._close_open(SAME_CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select"}) if tag not in ("td", "th") else frozenset({"table", "tr"}))
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        skipped = bool(self.stack) and self.stack[-1][1]
        at = self.at
        if not skipped:
            named = dict(attrs)
            names = _names(named) if attrs else set()
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or bool(named.get("style") and _HIDDEN.search(named["style"] or ""))
            skipped = tag in SKIPPED or (hidden and tag not in ("html", "body"))
            inside = self.article[at]
            part = False
            if tag not in ("html", "body", "main"):
                part = tag in PARTS or bool(names & BOILERPLATE - ({"header"} if inside else set())) or (tag == "header" and not inside)
            if (tag in CONTAINERS or part) and not skipped:
                self.parents.append(at)
                self.part.append(self.part[at] or part)
                self.article.append(inside or tag in ("article", "main") or bool(names & ARTICLE_WORDS))
                self.region.append(tag in REGIONS)
                at = len(self.parents) - 1
        if tag == "a":
            self.in_link += 1
        self.stack.append((tag, skipped, at))
        self.at = at

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Midway between the means of the two clusters (two-means on a line)."""
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        below, above = [v for v in values if v < middle], [v for v in values if v >= middle]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def line_ratios(reader: _Reader) -> list[float]:
    """Text outside links by tags, scaled by what the markup says of its container."""
    scale = [IN_PART if p else IN_ARTICLE if a else 1.0 for p, a in zip(reader.part, reader.article)]
    return [scale[at] * max(0, len(text) - links) / max(1, tags) for text, tags, links, at, _ in reader.lines]


def content_region(reader: _Reader) -> set[int]:
    """Containers whose lines are main text."""
    lines, parents = reader.lines, reader.parents
    ratios = line_ratios(reader)
    smoothed = smooth(ratios)
    least = threshold(smoothed)
    votes, sums, counts, linked = ([0.0] * len(parents) for _ in range(4))
    for (text, _, links, at, _), ratio, own in zip(lines, smoothed, ratios):
        vote = max(0, len(text) - links) if ratio >= least and own > 0 else 0
        while at >= 0:
            votes[at] += vote
            sums[at] += own
            counts[at] += 1
            linked[at] += links >= len(text)
            at = parents[at]
    children: list[list[int]] = [[] for _ in parents]
    for c, p in enumerate(parents[1:], 1):
        children[p].append(c)
    root, at = 0, 0
    while step := [c for c in children[at] if votes[c] > 0 and votes[c] >= MOST * votes[0]]:
        at = step[0]
        if reader.region[at]:
            root = at
    while root and (reader.article[parents[root]] or _only_headings(reader, root)):
        root = parents[root]

    def stays(c: int) -> bool:
        """Nothing speaks against it (a part by its markup, or a menu by its lines), or its own ratio reaches the threshold."""
        menu = counts[c] >= MENU and linked[c] == counts[c] and not reader.article[c]
        return not (reader.part[c] or menu) or (counts[c] > 0 and sums[c] / counts[c] >= least > 0)

    region, stack = set(), [root]
    while stack:
        c = stack.pop()
        region.add(c)
        stack += [k for k in children[c] if stays(k)]
    return region


def _only_headings(reader: _Reader, root: int) -> bool:
    """The container around root adds headings alone, right before it."""
    parent = reader.parents[root]
    if not parent:
        return False
    inside = [False] * len(reader.parents)
    inside[root] = True
    for c in range(root + 1, len(inside)):
        inside[c] = inside[reader.parents[c]]
    around = [False] * len(inside)
    around[parent] = True
    for c in range(parent + 1, len(around)):
        around[c] = around[reader.parents[c]]
    added = [heading for *_, at, heading in reader.lines if around[at] and not inside[at] and not reader.part[at]]
    return bool(added) and all(added)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    if not reader.lines:
        return ""
    region = content_region(reader)
    return "\n".join(text for text, _, _, at, _ in reader.lines if at in region)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars."""
    arrow_batches(pages.sparkSession)
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    kinds = [f.dataType.simpleString() for f in source.schema]
    schema = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(run, schema)
