"""Pages of any kind of source: HTML, OpenAPI documents, llms.txt and Markdown become one shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, token_estimate
from .contracts import parse_openapi
from .links import code_in, read_links
from .markdown import PAGE_SCHEMA, anchor, blocks, html_to_markdown

_INLINE = re.compile(r"(?<!!)\[([^\]]+)\]\(\s*([^)\s]+)[^)]*\)")


def body_kind(url: Column, content_type: Column, body: Column) -> Column:
    """openapi, html, llms_txt or markdown, by what the body begins with, its type and address."""
    start = F.ltrim(F.substring(F.coalesce(body, F.lit("")), 1, 2000))
    spec = start.startswith("{") & body.rlike(r'"(?:openapi|swagger)"\s*:')
    html = F.coalesce(content_type, F.lit("")).contains("text/html") | start.rlike(r"(?i)^(?:<!doctype html|<html|<head|<body)")
    return F.when(spec, "openapi").when(html, "html").when(url.rlike(r"/llms(?:-full)?\.txt$"), "llms_txt").otherwise("markdown")


def _links(text: str, base: str) -> list[dict]:
    found = [(t.strip(), h) for t, h in _INLINE.findall(text) if not h.startswith(("#", "javascript:"))]
    return [{"text": t, "url": u, "is_external": u.split("/")[:3] != base.split("/")[:3]} for t, h in found for u in [urljoin(base, h)]]


def markdown_page(text: str | None, url: str) -> dict:
    """Title, headings, code and links of Markdown; fenced text is code only."""
    parts = blocks(text or "")
    headings = [{"level": int(d), "text": t, "anchor": anchor(t)} for k, t, d in parts if k == "heading"]
    code = [{"language": d or None, "code": re.sub(r"^\s*[`~]{3,}[^\n]*\n?|\n?\s*[`~]{3,}\s*$", "", t)} for k, t, d in parts if k == "code"]
    links = [link for k, t, _ in parts if k != "code" for link in _links(t, url)]
    title = next((h["text"] for h in headings if h["level"] == 1), None) or next((h["text"] for h in headings), "Untitled")
    return {"title": title, "markdown": (text or "").strip(), "headings": headings, "links": links, "code": code}


def openapi_page(body: str, url: str) -> dict:
    """An API document as readable Markdown: a section for each endpoint."""
    try:
        info = json.loads(body).get("info") or {}
    except (ValueError, AttributeError):
        info = {}
    lines = [f"# {info.get('title') or 'API'}", *([str(info["description"])] if info.get("description") else [])]
    for e in parse_openapi(body):
        lines += [f"## {e['method']} {e['path']}", *([e["summary"]] if e["summary"] else []), *(["> [!WARNING]\n> Deprecated."] if e["deprecated"] else [])]
        lines += ["\n".join(f"- `{p['name']}` ({p['location']}{', required' if p['required'] else ''})" for p in e["parameters"])] if e["parameters"] else []
    return markdown_page("\n\n".join(lines), url)


def html_page(body: str | None, url: str) -> dict:
    """The page's Markdown, with code that only its payloads hold at the end."""
    page, reader = html_to_markdown(body, url), read_links(body, url)
    known = {c["code"].strip() for c in page["code"]}
    extra = [(lang, code) for p in reader.payloads for lang, _, code in code_in(p)] + [(lang, code.strip()) for lang, _, code in reader.attached]
    for lang, code in extra:
        if code and code not in known:
            known.add(code)
            page["code"] = [*page["code"], {"language": lang, "code": code}]
            page["markdown"] += f"\n\n```{lang or ''}\n{code}\n```"
    return page


_BUILDERS = {"openapi": openapi_page, "html": html_page, "llms_txt": markdown_page, "markdown": markdown_page}


def build_pages(raw: DataFrame) -> DataFrame:
    """raw (page_id, url, content_type, body) -> page_id, kind, title, markdown, headings, links, code, content_hash, estimated_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": p, "kind": k} | _BUILDERS[k](t, u or "") for p, u, k, t in zip(b["page_id"], b["url"], b["kind"], b["body"])]
            yield pd.DataFrame(rows, columns=["kind", "page_id", "title", "markdown", "headings", "links", "code"])

    kind = body_kind(F.col("url"), F.col("content_type"), F.col("body"))
    built = raw.select(F.col("page_id").cast("string").alias("page_id"), "url", kind.alias("kind"), "body").mapInPandas(run, "kind string, " + PAGE_SCHEMA)
    return built.withColumns({"content_hash": content_hash(F.col("markdown")), "estimated_tokens": token_estimate(F.col("markdown"))})
