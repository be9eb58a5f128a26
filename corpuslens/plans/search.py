"""Queries that search stored indexes of whole tables, and joins over them, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import index, packer, substrings, templates
from ..operators.segments import TextIndex, page_search
from ..sources import linktree, merkle
from ..sources.scratch import shared_dir
from . import corpus

t = corpus.t


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among the scratch tables; it goes when the session ends."""
    path = f"{shared_dir(spark)}/corpuslens-{uuid.uuid4().hex}/{name}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder.getParent())
    return path


#: One index for each application and state of a table's files; a search does not index again what did not change.
_BUILT: dict[tuple, TextIndex] = {}


def documents_index(spark: SparkSession, sf: str) -> TextIndex:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (spark.sparkContext.applicationId, sf, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength())
    if state not in _BUILT:
        made = TextIndex(spark, _folder(spark, "index"), "doc_id", ["text"])
        made.upsert(t(spark, sf, "documents"))
        _BUILT[state] = made
    return _BUILT[state]


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return index.query_units(corpus._queries(spark, sf), T.chunk_tokens(F.col("query")))


def stored_search(spark, sf):
    """An index of an earlier state of the documents, brought up to date: every tenth document had another text,
    the documents after each of them were not there yet, and some were that are no longer."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    kind = F.pmod("doc_id", F.lit(10))
    idx = TextIndex(spark, _folder(spark, "index"), "doc_id", ["text"])
    idx.upsert(d.where(kind != 1).withColumn("text", F.when(kind == 0, F.reverse("text")).otherwise(F.col("text"))).unionByName(d.where(kind == 2).withColumn("doc_id", -1 - F.col("doc_id"))))
    idx.upsert(d.where(kind < 2))
    idx.delete(d.where(kind == 2).select((-1 - F.col("doc_id")).alias("doc_id")))
    best, _ = idx.top(_units(spark, sf), 10)
    return best.select("query_id", F.col("id").alias("doc_id"), "score", F.col("position").cast("long").alias("position"))


def indexed_search(spark, sf):
    """Every word of an item, stop words too, over the stored index."""
    best, _ = documents_index(spark, sf).top(_units(spark, sf), 10)
    return best.select("query_id", F.col("id").alias("doc_id"), "score", F.col("position").cast("long").alias("position"))


def search_blocks(spark, sf):
    """What a search of the stored index scores: posting blocks of a query's terms, and those that the threshold leaves."""
    return documents_index(spark, sf).top(_units(spark, sf), 10)[1]


def phrase_positions(spark, sf):
    """Whole items as phrases, by stored positions."""
    units = index.query_units(corpus._queries(spark, sf), F.array(F.array_join(T.terms(F.col("query")), "-")))
    return documents_index(spark, sf).unit_counts(units).select("query_id", F.col("id").alias("doc_id"), F.col("tf").cast("long").alias("tf"))


def phrase_search(spark, sf):
    """Pages by the title of each page as one phrase, in titles and texts."""
    p = t(spark, sf, "pages")
    title = T.unescape_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    pages = p.select("page_id", title.alias("title"), F.regexp_replace("html", "(?s)<[^>]*>", " ").alias("body"))
    idx = TextIndex(spark, _folder(spark, "pages"), "page_id", ["title", "body"])
    idx.upsert(pages)
    best = page_search(idx, pages.select(F.col("page_id").alias("query_id"), T.terms(T.trimmed_title(F.col("title"))).alias("terms")), 10)
    return best.select("query_id", F.col("id").alias("page_id"), "score", F.col("position").cast("long").alias("position"))


def _search(spark, sf, limit):
    return index.search(documents_index(spark, sf), corpus._chunks(spark, sf), corpus._queries(spark, sf), T.chunk_tokens(F.col("query")), limit)


def hybrid_search(spark, sf):
    return _search(spark, sf, 10).select("query_id", F.col("id").alias("doc_id"), "hybrid", F.array_join("reasons", "; ").alias("reasons"), F.col("position").cast("long").alias("position"))


def pack_context(spark, sf):
    c = _search(spark, sf, 30).select("query_id", F.col("id").cast("string").alias("id"), F.col("source").alias("page_id"), F.array_join("section_path", " > ").alias("section"), F.col("id").alias("ordinal"), "token_estimate", F.col("hybrid").alias("score"), "position")
    return packer.pack_context(c)


def substring_matches(spark, sf):
    """All items as they stand in all documents, in any case."""
    b = t(spark, sf, "benchmark").select("item_id", F.lower("text").alias("pattern"))
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return substrings.containing(d, b).select("item_id", F.col("id").alias("doc_id"))


def link_tree(spark, sf):
    """The tree of every host: folders, pages and what they link to, with depths and why an address is not followed."""
    links = linktree.page_links(t(spark, sf, "pages"))
    roots = links.select(F.concat(F.regexp_extract("src", linktree.ORIGIN, 1), F.lit("/")).alias("url"))
    tree = linktree.link_tree(links, roots)
    return tree.select("url", F.coalesce("parent", F.lit("")).alias("parent"), F.col("depth").cast("long").alias("depth"), F.coalesce("reason", F.lit("")).alias("reason"))


def snapshot_changes(spark, sf):
    """The documents against an earlier state: those of one language and source had other texts, others were missing or are gone."""
    now = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.content_hash(F.col("text")).alias("content_hash"), "lang", "n_chars")
    was = now.where("n_chars % 50 <> 7").withColumn("content_hash", F.when(F.expr("lang = 'fr' and n_chars % 20 = 3"), F.sha1(F.col("content_hash").cast("binary"))).otherwise(F.col("content_hash")))
    was = was.unionByName(now.where("n_chars % 50 = 11").withColumn("id", -1 - F.col("id")))
    digits = merkle.depth_for(now.count())
    old, new = (merkle.Snapshot.take(x.select("id", "content_hash"), _folder(spark, name), digits) for x, name in ((was, "was"), (now, "now")))
    return merkle.changes(old, new)[0].withColumnRenamed("id", "doc_id")


def page_templates(spark, sf):
    """All page paths against templates made of them: numbers as wildcards, the first segment as one too, and paths as they are."""
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    p = t(spark, sf, "pages").select("page_id", path.alias("path"))
    numbered = F.regexp_replace("path", r"/[0-9]+(?=/|$|\.)", "/{n}")
    made = F.explode(F.array(numbered, F.regexp_replace(numbered, "^/[^/]+", "/{first}"), F.when(F.col("path").endswith("0"), F.col("path"))))
    return templates.match_templates(p, p.select(made.alias("template"))).select("page_id", F.coalesce("template", F.lit("")).alias("template"))


QUERIES = {f.__name__: f for f in (stored_search, indexed_search, search_blocks, phrase_positions, phrase_search, hybrid_search, pack_context, substring_matches, link_tree, snapshot_changes, page_templates)}

_ALL_WORDS = corpus._BM25.replace(f"list_distinct({corpus._SEARCH})", f"list_distinct({corpus._WORDS.format('text')})")
assert _ALL_WORDS != corpus._BM25
_TOP = _ALL_WORDS + "SELECT query_id, doc_id, score, position FROM ranked WHERE position <= 10"
_SKIP = rf"""CASE WHEN regexp_matches(path, '/({U.IRRELEVANT})(/|$)') THEN 'irrelevant' WHEN regexp_matches(path, '\.(png|jpe?g|gif|svg|css|js|ico|woff2?|zip|pdf|mp4)$') THEN 'asset' WHEN depth > 3 THEN 'depth' ELSE '' END"""
#: The pages' own addresses and links as resolved_link() has them: hosts small, no fragments, no tracking parameters, no slash at the end.
_RESOLVED = "regexp_replace({o} || CASE WHEN {p} = '' THEN '/' ELSE {p} END, '(://[^/]+/.*)/$', '\\1') || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END"
_KEPT = "list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{x}'" for x in U.LINK_TRACKING) + "], lower(split_part(x, '=', 1))))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_TRIMMED = r"trim(regexp_extract(title, '^(.*?)(?:\s[|\-–—]\s.*)?$', 1), ' ')"

ORACLES = {
    "stored_search": _TOP,
    "indexed_search": _TOP,
    "phrase_positions": corpus.ORACLES["bm25_phrase"],
    "phrase_search": rf"""
WITH p AS (SELECT page_id, {corpus._UNESCAPE.format(corpus._TITLE)} AS title, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS body FROM pages),
w AS (SELECT page_id, {corpus._TERMS.format("title")} AS a, {corpus._TERMS.format("body")} AS b, {corpus._TERMS.format(_TRIMMED)} AS terms FROM p),
docs AS (SELECT page_id, len(a) + len(b) AS n, list_concat(a, ['|'], b) AS w, ' ' || array_to_string(list_concat(a, ['|'], b), ' ') || ' ' AS s FROM w),
stats AS (SELECT count(*) AS nd, avg(n) AS al FROM docs),
q AS (SELECT DISTINCT terms FROM w WHERE len(terms) > 0),
hits AS (SELECT terms, page_id, n, len(list_filter(generate_series(1, len(w) - len(terms) + 1), lambda i: w[i:i + len(terms) - 1] = terms)) AS tf
  FROM q JOIN docs ON contains(s, ' ' || array_to_string(terms, ' ') || ' ')),
df AS (SELECT terms, count(*) AS df FROM hits GROUP BY terms),
scored AS (SELECT terms, page_id, round(CASE WHEN ln((nd - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - df + 0.5) / (df + 0.5)) END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / al)), 6) AS score FROM hits JOIN df USING (terms), stats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY terms ORDER BY score DESC, page_id) AS position FROM scored)
SELECT w.page_id AS query_id, ranked.page_id, score, position FROM w JOIN ranked USING (terms) WHERE position <= 10""",
    "substring_matches": "SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(lower(documents.text), lower(benchmark.text))",
    "link_tree": rf"""
WITH RECURSIVE u AS (SELECT url, html, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS o, {_PATH} AS p, {_KEPT.format("url")} AS q FROM pages),
pg AS (SELECT {_RESOLVED.format(o="o", p="p", q="q")} AS src, o, html FROM u),
h AS (SELECT src, o, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS h FROM pg),
hp AS (SELECT src, o, regexp_replace(h, '[?#].*$', '') AS p, {_KEPT.format("h")} AS q FROM h WHERE starts_with(h, '/')),
seg AS (SELECT DISTINCT src, o, list_filter(string_split(regexp_replace(regexp_replace(src, '[?#].*$', ''), '^[a-z]+://[^/?#]+/?', ''), '/'), lambda x: x <> '') AS s FROM pg),
st AS (SELECT src, o, s, unnest(generate_series(1, len(s))) AS n FROM seg WHERE len(s) > 0),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, {_RESOLVED.format(o="o", p="p", q="q")} AS dst FROM hp
  UNION ALL SELECT CASE WHEN n = 1 THEN o || '/' ELSE o || '/' || array_to_string(s[1:n - 1], '/') END, CASE WHEN n = len(s) THEN src ELSE o || '/' || array_to_string(s[1:n], '/') END FROM st) WHERE src <> dst),
tree AS (SELECT DISTINCT o || '/' AS url, 0 AS depth, '' AS reason FROM (SELECT DISTINCT regexp_extract(src, '^([a-z]+://[^/?#]+)', 1) AS o FROM e)
  UNION SELECT dst, depth, {_SKIP} FROM (SELECT e.dst, tree.depth + 1 AS depth, lower(regexp_extract(e.dst, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS path FROM tree JOIN e ON e.src = tree.url WHERE tree.reason = '')),
first AS (SELECT url, min(depth) AS depth, arg_min(reason, depth) AS reason FROM tree GROUP BY url)
SELECT c.url, coalesce(min(p.url), '') AS parent, CAST(c.depth AS BIGINT) AS depth, c.reason FROM first c
  LEFT JOIN e ON e.dst = c.url AND c.depth > 0 LEFT JOIN first p ON p.url = e.src AND p.depth = c.depth - 1 AND p.reason = '' GROUP BY c.url, c.depth, c.reason""",
    "snapshot_changes": """SELECT CASE WHEN g THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN g THEN 'removed' WHEN n_chars % 50 = 7 THEN 'added' ELSE 'changed' END AS change
FROM (SELECT *, unnest([false, true]) AS g FROM documents) WHERE CASE WHEN g THEN n_chars % 50 = 11 ELSE n_chars % 50 = 7 OR (lang = 'fr' AND n_chars % 20 = 3) END""",
    "page_templates": rf"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
n AS (SELECT page_id, path, regexp_replace(path, '/[0-9]+(/|$|\.)', '/{{n}}\1') AS num FROM p),
t AS (SELECT DISTINCT unnest([num, regexp_replace(num, '^/[^/]+', '/{{first}}'), CASE WHEN path LIKE '%0' THEN path END]) AS t FROM n),
c AS (SELECT t, string_split(regexp_replace(regexp_replace(lower(t), '/+$', ''), '^/', ''), '/') AS s FROM t WHERE t IS NOT NULL),
k AS (SELECT s, min(t) AS t FROM (SELECT t, list_transform(s, lambda x: CASE WHEN regexp_full_match(x, '\{{[^}}]+\}}|:[a-z0-9_]+') THEN '*' ELSE x END) AS s FROM c) GROUP BY s),
d AS (SELECT DISTINCT path, string_split(regexp_replace(regexp_replace(lower(path), '/+$', ''), '^/', ''), '/') AS s FROM p),
f AS (SELECT path, arg_min(t, array_to_string(list_transform(k.s, lambda x: CASE WHEN x = '*' THEN 'w' ELSE 'l' END), '')) AS t FROM d JOIN k ON len(d.s) = len(k.s)
  AND len(list_filter(list_zip(d.s, k.s), lambda z: NOT (z[1] = z[2] OR (z[2] = '*' AND z[1] <> '')))) = 0 GROUP BY path)
SELECT page_id, coalesce(t, '') AS template FROM p LEFT JOIN f USING (path)""",
}
