"""Pages to Markdown, and Markdown to section-aware chunks.

The row-wise parsers are state machines over lines or parser events; they run as Arrow
batches (one Python call a page), everything between rows is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

MAX_TOKENS, TARGET_TOKENS = 1000, 500
#: Rows that go back from Python at once.
OUT_ROWS = 128
DROPPED = frozenset("script style noscript svg iframe nav header footer template".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_SIDE = re.compile(r"(?:^|[\s_-])(?:sidebar|toc|menu|cookie)(?:$|[\s_-])", re.I)
PAGE_SCHEMA = (
    "page_id string, title string, markdown string, headings array<struct<level:int,text:string,anchor:string>>, "
    "links array<struct<text:string,url:string,is_external:boolean>>, code array<struct<language:string,code:string>>"
)
CHUNK_SCHEMA = "page_id string, ordinal long, part long, title string, section_path array<string>, content string, chunk_type string, token_estimate long, code array<struct<language:string,code:string>>"


def anchor(text: str) -> str:
    return re.sub(r"-{2,}", "-", re.sub(r"[\s_]+", "-", re.sub(r"[^a-z0-9_\s-]", "", text.lower().strip()))).strip("-")


class _Markdown(HTMLParser):
    """Writes Markdown as events come by; code is kept as it stands, so nothing that
    later cleans white space touches it."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skip, self.pre = base, [], 0, None
        self.title, self.headings, self.links, self.code = "", [], [], []
        self.open: list[tuple[str, bool]] = []
        self.frames: list[tuple[str, list, str]] = []  # captured inline text: tag, text, detail
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.head_done = False

    def write(self, text: str) -> None:
        (self.frames[-1][1] if self.frames else self.out).append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        drop = tag in DROPPED or (tag in ("div", "aside", "section") and bool(_SIDE.search(f"{a.get('class') or ''} {a.get('id') or ''}")))
        if tag not in VOID:
            self.open.append((tag, drop))
            self.skip += drop
        if self.skip or self.pre is not None:
            if self.pre is not None and tag == "code" and (m := re.search(r"lang(?:uage)?-([\w+#-]+)", a.get("class") or "")):
                self.pre[0] = m[1]
            return
        if tag == "pre":
            m = re.search(r"lang(?:uage)?-([\w+#-]+)", a.get("class") or "")
            self.pre = [m[1] if m else "", []]
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "a", "title"):
            self.frames.append((tag, [], a.get("href") or ""))
        elif tag in ("strong", "b"):
            self.write("**")
        elif tag in ("em", "i"):
            self.write("*")
        elif tag == "code":
            self.write("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.write("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.frames.append((tag, [], ""))
        elif tag == "table":
            self.head_done = False
            self.write("\n\n")
        elif tag == "br":
            self.write("\n")
        elif tag == "hr":
            self.write("\n\n---\n\n")
        elif tag == "blockquote":
            self.write("\n\n> ")
        elif tag in ("p", "div", "section", "article", "main", "details", "summary"):
            self.write("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, drop = self.open.pop()
            self.skip -= drop
            if t == tag:
                break
        if self.skip:
            return
        if tag == "pre" and self.pre is not None:
            code = "".join(self.pre[1]).strip("\n")
            self.code.append({"language": self.pre[0] or None, "code": code})
            self.write(f"\n\n\x00{len(self.code) - 1}\x00\n\n")
            self.pre = None
            return
        if self.pre is not None:
            return
        if self.frames and self.frames[-1][0] == tag:
            _, parts, detail = self.frames.pop()
            text = re.sub(r"\s+", " ", "".join(parts)).strip()
            if tag == "title":
                self.title = self.title or text
            elif tag == "a":
                if text and detail and not re.match(r"(?i)(javascript|mailto|tel|data):|#", detail):
                    url = urljoin(self.base, detail)
                    origin = re.match(r"[a-z]+://[^/]+", self.base or "")
                    self.links.append({"text": text, "url": url, "is_external": not (origin and url.startswith(origin[0]))})
                    self.write(f"[{text}]({url})")
                else:
                    self.write(text)
            elif tag in ("td", "th"):
                if self.row is not None:
                    self.row.append(text.replace("|", "\\|"))
            elif text:
                self.headings.append({"level": int(tag[1]), "text": text, "anchor": anchor(text)})
                self.write(f"\n\n{'#' * int(tag[1])} {text}\n\n")
        elif tag == "tr" and self.row is not None:
            self.write("| " + " | ".join(self.row) + " |\n")
            if not self.head_done and self.row:
                self.write("|" + " --- |" * len(self.row) + "\n")
                self.head_done = True
            self.row = None
        elif tag in ("strong", "b"):
            self.write("**")
        elif tag in ("em", "i"):
            self.write("*")
        elif tag == "code":
            self.write("`")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.write("\n\n")
        elif tag in ("p", "table", "blockquote", "div", "details", "summary"):
            self.write("\n\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            if any(t == "title" for t, _ in self.open) and not self.title:
                self.title = data.strip()
        elif self.pre is not None:
            self.pre[1].append(data)
        else:
            self.write(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None, base: str = "") -> dict:
    m = _Markdown(base or "")
    m.feed(html or "")
    m.close()
    while m.frames:
        _, parts, _ = m.frames.pop()
        m.write("".join(parts))
    text = re.sub(r"[ \t]+\n", "\n", "".join(m.out))
    text = re.sub(r"\n[ \t]+(?=[^\s\-0-9])", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    for i, c in enumerate(m.code):
        text = text.replace(f"\x00{i}\x00", f"```{c['language'] or ''}\n{c['code']}\n```", 1)
    title = re.split(r"\s[|\-–—]\s", m.title or "")[0].strip() or next((h["text"] for h in m.headings if h["level"] == 1), "Untitled")
    return {"title": title, "markdown": text, "headings": m.headings, "links": m.links, "code": m.code}


def row_by_row(run: Callable[..., Iterator[dict]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a row's columns that gives rows. A batch stays in Arrow's buffers, its rows become objects one
    at a time, and OUT_ROWS of what they give go back at once, however many rows a batch has."""
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                held += run(*(c[i].as_py() for c in batch.columns))
                if len(held) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return batch_by_batch


def normalize_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(page_id: str, url: str, html: str) -> Iterator[dict]:
        yield {"page_id": page_id} | html_to_markdown(html, url)

    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(row_by_row(run, PAGE_SCHEMA), PAGE_SCHEMA)


def blocks(markdown: str) -> list[tuple[str, str, str]]:
    """(kind, text, detail): headings (detail: level), fenced code (language), warnings
    and paragraphs. An unclosed fence runs to the end; blank lines end a paragraph, a
    warning goes on while lines are quoted."""
    out, lines, i = [], (markdown or "").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"^\s*(```+|~~~+)\s*([\w+#.-]*)", line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^\s*{re.escape(m[1])}\s*$", lines[j]):
                j += 1
            out.append(("code", "\n".join(lines[i : j + 1]), m[2]))
            i = j + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(("heading", m[2], str(len(m[1]))))
            i += 1
        elif re.match(r"(?i)^\s*(>\s*\[!(warning|caution|danger|important|note|tip)\]|:::\s*(warning|danger|caution|note|tip))", line):
            fenced, j = line.lstrip().startswith(":::"), i + 1
            while j < len(lines) and (not re.match(r"^\s*:::\s*$", lines[j]) if fenced else lines[j].lstrip().startswith(">")):
                j += 1
            j += fenced and j < len(lines)
            out.append(("warning", "\n".join(lines[i:j]), ""))
            i = j
        elif not line.strip():
            i += 1
        else:
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"^\s*(```|~~~|#{1,6}\s|>\s*\[!|:::)", lines[j]):
                j += 1
            j = max(j, i + 1)
            out.append(("prose", "\n".join(lines[i:j]), ""))
            i = j
    return out


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def chunk_kind(parts: list[tuple[str, str, str]], text: str) -> str:
    codes = [p for p in parts if p[0] == "code"]
    warned = any(p[0] == "warning" for p in parts)
    if re.search(r"\b(GET|POST|PUT|DELETE|PATCH)\s+/", text):
        return "api"
    if warned and len(parts) <= 2:
        return "warning"
    if codes and all(p[0] in ("code", "heading") for p in parts):
        return "code"
    if codes:
        return "example" if "example" in text.lower() else "mixed"
    return "prose"


def slice_markdown(markdown: str, title: str, max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS) -> list[dict]:
    sections: list[tuple[list[str], list]] = []
    trail: list[tuple[int, str]] = []
    held: list = []
    for b in blocks(markdown):
        if b[0] == "heading":
            if held:
                sections.append(([t for _, t in trail] or [title], held))
            level = int(b[2])
            trail = [t for t in trail if t[0] < level] + [(level, b[1])]
            held = []
        else:
            held.append(b)
    if held:
        sections.append(([t for _, t in trail] or [title], held))
    out = []
    for path, parts in sections:
        groups, size = [[]], 0
        whole = tokens("\n\n".join(p[1] for p in parts)) <= max_tokens
        for p in parts:
            n = tokens(p[1])
            if not whole and groups[-1] and size + n > target and p[0] != "warning":
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += n
        for n, g in enumerate(groups):
            text = "\n\n".join(p[1] for p in g)
            code = [{"language": p[2] or None, "code": re.sub(r"^\s*[`~]{3,}[^\n]*\n?|\n?\s*[`~]{3,}\s*$", "", p[1])} for p in g if p[0] == "code"]
            out.append({"ordinal": len(out), "part": n, "title": path[-1], "section_path": path, "content": text, "chunk_type": chunk_kind(g, text), "token_estimate": tokens(text), "code": code})
    return out


def slice_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """pages (page_id, title, markdown, and any other columns) -> chunks with chunk_id,
    content_hash and the page's doc_version, if it has one."""
    keep = ["page_id", "title", "markdown"]

    def run(page_id: str, title: str, markdown: str) -> Iterator[dict]:
        return ({"page_id": page_id} | c for c in slice_markdown(markdown, title, max_tokens, target))

    chunks = pages.select(*keep).mapInArrow(row_by_row(run, CHUNK_SCHEMA), CHUNK_SCHEMA)
    if "doc_version" in pages.columns:
        chunks = chunks.join(pages.select("page_id", "doc_version"), "page_id", "left")
    from ..functions.text import content_hash, short_id

    chunks = chunks.withColumn("content_hash", content_hash(F.col("content")))
    return chunks.withColumn("chunk_id", F.concat(F.lit("chk_"), short_id(F.col("page_id"), F.col("ordinal").cast("string"), F.col("content_hash"))))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): next, previous, parent_section and explains_code edges."""
    w = W.partitionBy("page_id").orderBy("ordinal")
    c = chunks.withColumns({"next": F.lead("chunk_id").over(w), "next_type": F.lead("chunk_type").over(w), "path": F.array_join("section_path", " > ")})
    forward = c.where("next is not null")
    edges = forward.select(F.col("chunk_id").alias("src"), F.col("next").alias("dst"), F.lit("next").alias("type"))
    edges = edges.unionByName(forward.select(F.col("next").alias("src"), F.col("chunk_id").alias("dst"), F.lit("previous").alias("type")))
    edges = edges.unionByName(forward.where("chunk_type in ('prose', 'warning') and next_type in ('code', 'example')").select(F.col("chunk_id").alias("src"), F.col("next").alias("dst"), F.lit("explains_code").alias("type")))
    # a section's further parts belong to its first one, a first one to the last earlier section around it
    c = c if "part" in chunks.columns else c.withColumn("part", F.lit(0))
    around = F.when(F.col("part") > 0, F.col("path")).when(F.size("section_path") > 1, F.array_join(F.slice("section_path", F.lit(1), F.size("section_path") - 1), " > "))
    roots = c.where("part = 0").select("page_id", F.col("path").alias("around"), F.col("chunk_id").alias("dst"), F.col("ordinal").alias("at"))
    parts = c.select("page_id", F.col("chunk_id").alias("src"), "ordinal", around.alias("around")).where("around is not null")
    parent = parts.join(roots, ["page_id", "around"]).where("at < ordinal").groupBy("src").agg(F.max_by("dst", "at").alias("dst"))
    return edges.unionByName(parent.select("src", "dst", F.lit("parent_section").alias("type")))


#: Symbol kinds and the patterns that show them, in order.
SYMBOLS = (
    ("endpoint", r"(?<![A-Za-z0-9_])((?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s+/[a-zA-Z0-9_{}/:.-]+)"),
    ("function", r"(?<![A-Za-z0-9_])(?:function|def|func|fn)\s+([a-zA-Z0-9_$]+)\s*\("),
    ("function", r"(?<![A-Za-z0-9_])(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    ("class", r"(?<![A-Za-z0-9_])class\s+([a-zA-Z0-9_$]+)"),
    ("interface", r"(?<![A-Za-z0-9_])(?:interface|struct|enum)\s+([a-zA-Z0-9_$]+)"),
    ("type", r"(?<![A-Za-z0-9_])type\s+([A-Z][a-zA-Z0-9_$]*)\s*="),
    ("config", r"(?m)^[ \t]*([a-zA-Z0-9_.-]{3,30})\s*:\s*\S"),
)
NO_CONFIG = ("http", "https", "note", "warning", "tip", "important", "version")


def extract_symbols(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, kind): the first kind of each name, names of 2 to 79 characters."""
    def named(kind: str, rank: int):
        return lambda n: F.struct(F.trim(n).alias("name"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), 1), named(k, r)) for r, (k, p) in enumerate(SYMBOLS)]))
    s = chunks.select("chunk_id", F.posexplode(found).alias("pos", "s")).select("chunk_id", "pos", "s.*")
    s = s.where(F.length("name").between(2, 79) & ~((F.col("kind") == "config") & F.lower("name").isin(*NO_CONFIG)))
    return s.groupBy("chunk_id", "name").agg(F.min_by("kind", F.struct("rank", "pos")).alias("kind"))
