"""Finding documentation sources: candidate addresses, checks of their content, and the
union of what several providers found. Fetching is injected: a function from address to
(status, content type, body); rows of fetched pages are the engine's input."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bounded
from ..functions.urls import allowed_url
from .scratch import written

#: Paths that a provider tries, in order of precedence of the providers.
CANDIDATES = {
    "llms_txt": ("/llms.txt", "/docs/llms.txt", "/.well-known/llms.txt"), "llms_full_txt": ("/llms-full.txt", "/docs/llms-full.txt"), "openapi": ("/openapi.json", "/swagger.json", "/api/openapi.json", "/v1/openapi.json", "/api-docs"),
    "markdown": ("/README.md", "/docs.md", "/index.md"), "sitemap": ("/sitemap.xml", "/robots.txt"), "skill": ("/skill.md", "/SKILL.md"),
}


def candidate_urls(sites: DataFrame) -> DataFrame:
    """(site, type, rank, url) to probe for each site (column url)."""
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    rows = [F.struct(F.lit(k).alias("type"), F.lit(i).alias("rank"), F.concat(origin, F.lit(p)).alias("url")) for i, (k, p) in enumerate((k, p) for k, ps in CANDIDATES.items() for p in ps)]
    return sites.select(F.col("url").alias("site"), F.explode(F.array(*rows)).alias("c")).select("site", "c.*")


def safe_only(urls: DataFrame, ip_col: str = "ip") -> DataFrame:
    return urls.where(allowed_url(F.col("url"), F.col(ip_col)))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]], max_bytes: int = 10_000_000) -> DataFrame:
    """url -> url, status, content_type, body; a failure is status 0, a long body is cut off as an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    status, kind, body = fetch(u)
                    rows.append((u, status, kind, body) if len(body) <= max_bytes else (u, 413, kind, ""))
                except Exception as e:  # noqa: BLE001  whatever the fetcher raises is that row's failure
                    rows.append((u, 0, type(e).__name__, ""))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body"])

    return urls.select("url").distinct().mapInPandas(run, "url string, status int, content_type string, body string")


def is_llms_txt(body: Column) -> Column:
    """A title line and a list of links."""
    return body.rlike(r"(?m)^#\s+\S") & body.rlike(r"(?m)^\s*[-*]\s*\[[^\]]+\]\([^)]+\)") & ~body.rlike("(?is)^\\s*(<!doctype|<html)")


def valid_source(kind: Column, status: Column, body: Column) -> Column:
    """Whether what was fetched is what the provider looks for."""
    json_spec = F.coalesce(F.get_json_object(body, "$.openapi"), F.get_json_object(body, "$.swagger")).isNotNull()
    fits = (
        F.when(kind == "llms_txt", is_llms_txt(body)).when(kind == "llms_full_txt", (F.length(body) > 200) & ~body.rlike("(?is)^\\s*<")).when(kind == "openapi", F.when(body.rlike(r"^\s*\{"), json_spec).otherwise(body.rlike(r"(?m)^(openapi|swagger):\s*['\"]?\d")))
        .when(kind == "markdown", body.rlike(r"(?m)^#{1,3}\s+\S") & ~body.rlike("(?is)^\\s*<")).when(kind == "sitemap", body.rlike("(?is)<(urlset|sitemapindex)|^sitemap:")).when(kind == "skill", body.rlike(r"(?s)^---\s*\n.*?name:.*?\n---"))
        .otherwise(status == 200)
    )
    return (status == 200) & F.coalesce(fits, F.lit(False))


def union_sources(found: DataFrame) -> DataFrame:
    """One row for each address, any case: the first provider's (lowest rank)."""
    key = W.partitionBy(F.lower("url")).orderBy("rank", "url")
    return found.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def github_repositories(pages: DataFrame, html_col: str = "html") -> DataFrame:
    found = F.regexp_extract_all(html_col, F.lit(r"(?i)https?://github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"), 1)
    repos = pages.select(F.explode(F.array_distinct(found)).alias("repo")).withColumn("repo", F.regexp_replace("repo", r"(?:\.git|\.)$", ""))
    skip = F.lower(F.substring_index("repo", "/", 1)).isin("features", "topics", "sponsors", "about", "orgs", "marketplace", "login")
    return repos.where(~skip).select(F.concat(F.lit("https://github.com/"), "repo").alias("url")).distinct()


#: Fixed values: (name, weight) of the signs of a documentation site, and the threshold.
SIGNS = (("generator", 0.35), ("structure", 0.25), ("code", 0.20), ("url", 0.20), ("api", 0.15), ("title", 0.15), ("version", 0.05), ("links", 0.10))
THRESHOLD = 0.40


def documentation_score(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds sign columns, score and is_documentation."""
    url, html = F.lower(url_col), F.lower(html_col)
    anchors = F.regexp_count(html, F.lit(r"<a\s"))
    inner = F.regexp_count(html, F.lit(r"<a\s[^>]*href=[\"'](?:/|\.|#)"))
    signs = {
        "generator": html.rlike(r"docusaurus|vitepress|mkdocs|sphinx|gitbook|readme\.io|mintlify|nextra|redoc|swagger-ui|starlight|docsify"),
        "structure": html.rlike(r"<(aside|nav)[^>]*(sidebar|toc|menu)|class=[\"'][^\"']*(sidebar|toc|breadcrumb)"), "code": html.rlike("<pre|<code"),
        "url": url.rlike(r"://(docs?|developers?|api|learn|help)\.|/(docs?|documentation|guides?|reference|api|manual|tutorials?)(/|$)"),
        "api": html.rlike(bounded("api reference|endpoints?|rest api|graphql|sdk")), "title": F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1).rlike(bounded("docs|documentation|guide|reference|manual|tutorial")),
        "version": html.rlike(r"(?<![a-z0-9_])v\d+\.\d+"), "links": (anchors >= 5) & (inner >= 0.6 * anchors),
    }
    out = pages.withColumns({"sign_" + k: F.coalesce(v, F.lit(False)) for k, v in signs.items()})
    score = sum((F.when(F.col("sign_" + k), w).otherwise(0.0) for k, w in SIGNS), F.lit(0.0))
    return out.withColumn("score", F.least(F.lit(1.0), score)).withColumn("is_documentation", F.round("score", 6) >= THRESHOLD)


def documentation_root(probes: DataFrame, max_probes: int = 12) -> DataFrame:
    """Of each site's probed pages (site, url, html, rank) the one of highest score, the first among equals."""
    few = probes.where(F.col("rank") < max_probes)
    return documentation_score(few).groupBy("site").agg(F.max_by("url", F.struct("score", -F.col("rank"))).alias("root"), F.max("score").alias("confidence"))


_LINK = re.compile(r"^\s*[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)\s*:?\s*(.*)$")


def parse_llms_txt(text: str | None) -> list[dict]:
    """(section, title, url, description) of the links of an llms.txt."""
    section, out = "", []
    for line in (text or "").splitlines():
        if m := re.match(r"^##\s+(.*?)\s*$", line):
            section = m[1]
        elif m := _LINK.match(line):
            out.append({"section": section, "title": m[1], "url": m[2], "description": m[3]})
    return out


def llms_links(pages: DataFrame, body_col: str = "body") -> DataFrame:
    schema = "array<struct<section:string,title:string,url:string,description:string>>"

    @F.pandas_udf(schema)
    def links(bodies: pd.Series) -> pd.Series:
        return bodies.map(parse_llms_txt)

    return pages.select(F.col("url").alias("source"), F.posexplode(links(body_col)).alias("position", "l")).select("source", "position", "l.*")


def crawl(seeds: DataFrame, fetch_wave: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame], max_depth: int = 3, max_pages: int = 500) -> DataFrame:
    """Breadth-first waves: each depth is one DataFrame. seeds: url. fetch_wave adds body;
    links_of gives (parent, url, priority). Bounded by depth and pages, as a crawler must be."""
    from pyspark.sql import functions as F  # noqa: PLW0621

    wave = seeds.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    pages = written(fetch_wave(wave), "wave")
    for depth in range(1, max_depth + 1):
        seen = pages.count()
        new = links_of(pages.where(F.col("depth") == depth - 1)).join(pages.select("url"), "url", "left_anti")
        best = new.groupBy("url").agg(F.min_by("parent", F.struct("priority", "parent")).alias("parent"), F.min("priority").alias("priority")).orderBy("priority", "url").limit(max(0, max_pages - seen))
        wave = written(fetch_wave(best.select("url", "parent", F.lit(depth).alias("depth"))), "wave")
        if not wave.take(1):
            break
        pages = pages.unionByName(wave)
    return pages


def tree_edges(pages: DataFrame) -> DataFrame:
    """(url, parent, depth) with orphans attached to the root (depth 0)."""
    root = pages.where("depth = 0").agg(F.min("url").alias("root"))
    known = pages.select(F.col("url").alias("parent"), F.lit(True).alias("known"))
    e = pages.join(known, "parent", "left").withColumn("k", F.lit(0)).join(F.broadcast(root.withColumn("k", F.lit(0))), "k")
    return e.select("url", F.when(F.col("url") == F.col("root"), None).when(F.col("known"), F.col("parent")).otherwise(F.col("root")).alias("parent"), "depth")
