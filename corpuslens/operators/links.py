"""Links of raw pages by the region they stand in, routes in JSON payloads, and code that pages hydrate from them.

One parser run a page yields rows; choosing among equal addresses is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Regions of a page in order of trust, query parameters that only track, and keys that name a route.
REGIONS = ("nav_sidebar", "breadcrumb", "category", "body", "prev_next", "related", "footer", "unknown")
TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content ref source fbclid gclid".split())
ROUTE_KEYS = ("path", "href", "url", "route", "slug")
CODE_PARTS = frozenset("File Chunk Code CodeBlock Snippet CodeGroup CodeTab".split())
MIN_CODE = 15
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = (
    ("breadcrumb", re.compile(r"\bbreadcrumbs?\b")), ("prev_next", re.compile(r"\b(?:pagination|prev-next|pager|next-page|prev-page)\b")), ("related", re.compile(r"\b(?:related|see-also|further-reading)\b")),
    ("footer", re.compile(r"\bfooter\b")), ("nav_sidebar", re.compile(r"\b(?:sidebar|sphinxsidebar|toctree|md-nav|docs-menu|table-of-contents|navigation|collapse|collapsed|is-collapsed|hidden|d-none|menu-collapsed)\b")),
    ("category", re.compile(r"\b(?:category|card-grid|cards|index-list)\b")),
)
_TAGS = {"nav": "nav_sidebar", "aside": "nav_sidebar", "details": "nav_sidebar", "footer": "footer", "main": "body", "article": "body"}
LINK_SCHEMA = "page_id string, ordinal long, url string, text string, region string, category string"
CODE_SCHEMA = "page_id string, ordinal long, language string, filename string, code string"


def normal_link(href: str | None, base: str) -> str | None:
    """An absolute web address without fragment, tracking parameters and closing slash."""
    href = (href or "").strip()
    if not href or href.startswith("#") or re.match(r"(?i)(?:javascript|mailto|tel):", href):
        return None
    try:
        u = urlsplit(urljoin(base, href))
        port = u.port
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not u.hostname:
        return None
    host = u.hostname if port in (None, {"http": 80, "https": 443}[u.scheme]) else f"{u.hostname}:{port}"
    query = urlencode([(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in TRACKING])
    return urlunsplit((u.scheme, host, (u.path.rstrip("/") if len(u.path) > 1 else "") or "/", query, ""))


def routes_in(found: object, base: str, category: str | None = None) -> Iterator[tuple[str, str, str | None]]:
    """(address, text, category) of every route named anywhere in a JSON value."""
    held = [(found, category)]
    while held:
        value, group = held.pop()
        if isinstance(value, list):
            held += [(v, group) for v in reversed(value)]
        elif isinstance(value, dict):
            title = next((value[k] for k in ("title", "name") if isinstance(value.get(k), str)), None)
            group = value["category"] if isinstance(value.get("category"), str) else group or title
            for key in ROUTE_KEYS:
                target = value.get(key)
                if isinstance(target, str) and target.startswith(("/", "http")) and (url := normal_link(target, base)):
                    yield url, title or target, group
            held += [(v, group) for v in reversed(list(value.values())) if isinstance(v, (dict, list))]


class _Links(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.rows, self.payloads, self.attached = base, [], [], []
        self.open: list[tuple[str, str | None]] = []  # tag and the region it opens
        self.category: list[str | None] = []  # of the details around
        self.text: list[str] | None = None
        self.href, self.rel, self.script, self.summary = None, "", None, None

    def region(self) -> str:
        """The innermost region that was opened; a breadcrumb or footer around a menu wins over it."""
        opened = [r for _, r in self.open if r]
        for strong in ("footer", "breadcrumb", "prev_next"):
            if strong in opened:
                return strong
        return opened[-1] if opened else "unknown"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        names = " ".join(a.get(k, "") for k in ("class", "id", "aria-label", "role")).lower()
        if tag == "script" and ("json" in a.get("type", "") or a.get("id") == "__NEXT_DATA__"):
            self.script = []
        if "data-code" in a:
            self.attached.append((a.get("data-language") or a.get("data-lang"), a.get("data-filename"), a["data-code"]))
        if tag == "a" and "href" in a:
            self.href, self.rel, self.text = a["href"], a.get("rel", ""), []
        if tag in _VOID:
            return
        region = next((r for r, p in _NAMES if p.search(names)), None) if tag != "a" else None
        hidden = "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden") == "true"
        self.open.append((tag, region or ("nav_sidebar" if hidden and tag != "a" else _TAGS.get(tag))))
        if tag == "details":
            self.category.append(None)
        if tag == "summary":
            self.summary = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            try:
                self.payloads.append(json.loads("".join(self.script)))
            except ValueError:
                pass
            self.script = None
        if tag == "summary" and self.summary is not None:
            if self.category:
                self.category[-1] = " ".join("".join(self.summary).split()) or None
            self.summary = None
        if tag == "a" and self.text is not None:
            if url := normal_link(self.href, self.base):
                region = "prev_next" if self.rel in ("prev", "next") else self.region()
                self.rows.append((url, " ".join("".join(self.text).split()), region, next((c for c in reversed(self.category) if c), None)))
            self.text = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag == "details" and self.category:
            self.category.pop()

    def handle_data(self, data: str) -> None:
        for sink in (self.script, self.text, self.summary):
            if sink is not None:
                sink.append(data)


def read_links(html: str | None, base: str) -> _Links:
    reader = _Links(base or "")
    reader.feed(html or "")
    reader.close()
    return reader


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every link of a page, in order, with its region and category; routes of JSON payloads are menu entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                reader = read_links(html, url)
                found = reader.rows + [(u, t, "nav_sidebar", c) for p in reader.payloads for u, t, c in routes_in(p, url or "")]
                rows += [(page, i, *r) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "url", "text", "region", "category"])

    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, LINK_SCHEMA)


def best_links(links: DataFrame) -> DataFrame:
    """One link for each address of a page: of the best region, then the first. Its category, or the first that any of them names."""
    priority = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")).cast("long")
    ranked = links.withColumn("priority", F.when(priority > 0, priority).otherwise(99))
    best = F.min_by(F.struct("text", "region", "priority", "ordinal", "category"), F.struct("priority", "ordinal")).alias("b")
    named = F.min_by("category", F.when(F.col("category").isNotNull(), F.col("ordinal"))).alias("any_category")
    one = ranked.groupBy("page_id", "url").agg(best, named)
    return one.select("page_id", "url", "b.text", "b.region", "b.priority", F.coalesce("b.category", "any_category").alias("category"), "b.ordinal")


def code_in(payload: object, depth: int = 8) -> Iterator[tuple[str | None, str | None, str]]:
    """(language, file name, code) of a hydration payload: objects with code or a snippet, and code components."""
    text = lambda d, *keys: next((d[k] for k in keys if isinstance(d.get(k), str)), None)
    held = [(payload, 0)]
    while held:
        value, d = held.pop(0)
        if isinstance(value, dict):
            own = value.get("attributes") if value.get("name") in CODE_PARTS and isinstance(value.get("attributes"), dict) else value
            code = text(own, "code", "snippet", "content") if own is not value else text(value, "code", "snippet")
            if own is not value and code is None and isinstance(value.get("children"), list):
                code = "\n".join(c for c in value["children"] if isinstance(c, str)) or None
            if code and len(code.strip()) > MIN_CODE:
                yield text(own, "language", "lang"), text(own, "filename", "file", "title"), code.strip()
            value = [v for v in value.values() if v is not own or own is value]
        if isinstance(value, list) and d < depth:
            held += [(v, d + 1) for v in value if isinstance(v, (dict, list))]


def hydration_code(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Code that pages carry in JSON payloads and data-code attributes, each text once a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"]):
                reader = read_links(html, "")
                found = [c for p in reader.payloads for c in code_in(p)] + [c for c in reader.attached if c[2].strip()]
                once = list({c[2]: c for c in reversed(found)}.values())[::-1]
                rows += [(page, i, *c) for i, c in enumerate(once)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "language", "filename", "code"])

    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, CODE_SCHEMA)
