"""Queries over whole tables of the corpus: each applies operators of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import extract, index, markdown


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.token_estimate(F.col("text")).alias("tokens"))


def exact_dedupe(spark, sf):
    h = content_hash(spark, sf)
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def source_stats(spark, sf):
    d = t(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "en").alias("english"))


def docs_map(spark, sf):
    d = t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return d.groupBy("source").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", "n", "first", "last"))), ",").alias("langs"))


def paging(spark, sf):
    """The third page of 50 rows: the limit is the feature."""
    return t(spark, sf, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


def paragraph_chunks(spark, sf):
    p = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content")).where(F.trim("content") != "")
    return p.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"), F.max("ordinal").cast("long").alias("last"))


def chunk_edges(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next"), F.lag("turn").over(w).alias("previous"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    return c.select("conv_id", "turn", "ordinal", F.coalesce("next", F.lit(-1)).alias("next"), F.coalesce("previous", F.lit(-1)).alias("previous"))


def search_tokens(spark, sf):
    b = t(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("tokens"), T.intent(F.col("text")).alias("intent"))


def chunk_query_words(spark, sf):
    """Words that a chunk search asks for, of every benchmark item."""
    return t(spark, sf, "benchmark").select("item_id", F.array_join(T.chunk_tokens(F.col("text")), "|").alias("words"))


def _queries(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.intent(F.col("text")).alias("intent"), F.lit(None).cast("string").alias("target_version"))


def _index(spark, sf) -> DataFrame:
    return index.index_terms(t(spark, sf, "documents"), "doc_id", ["text"])


def bm25_or(spark, sf):
    q = _queries(spark, sf)
    best = index.top_k(index.bm25(_index(spark, sf), index.query_units(q, T.search_tokens(F.col("query"))), 10).withColumn("score", F.round("score", 6)), 10)
    return best.select("query_id", F.col("id").alias("doc_id"), "score", F.col("position").cast("long").alias("position"))


def bm25_prefix(spark, sf):
    """Every word of four and more letters of an item, as a beginning."""
    units = index.query_units(_queries(spark, sf), F.filter(T.search_tokens(F.col("query")), lambda w: F.length(w) >= 4), prefix_from=4)
    hits = index.unit_counts(_index(spark, sf), units)
    return hits.groupBy("query_id").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


def bm25_phrase(spark, sf):
    """Whole items as phrases."""
    units = index.query_units(_queries(spark, sf), F.array(F.array_join(T.terms(F.col("query")), "-")))
    hits = index.unit_counts(_index(spark, sf), units)
    return hits.select("query_id", F.col("id").alias("doc_id"), F.col("tf").cast("long").alias("tf"))


def like_fallback(spark, sf):
    """Items that a search has not found (here: those of even number) are looked for as they stand, in any case."""
    q = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    hits = index.any_token_fallback(q, q.where("query_id % 2 = 1"), t(spark, sf, "documents"), "doc_id", ["text"], F.array("query"))
    return hits.groupBy("query_id").agg(F.count("*").alias("docs"))


def _chunks(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents")
    symbols = F.array().cast("array<struct<name:string,kind:string>>")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring_index("text", ".", 1).alias("title"), F.array("source", "lang").alias("section_path"), F.lit("prose").alias("chunk_type"), symbols.alias("symbols"),
        F.lit(None).cast("string").alias("doc_version"), F.when(F.col("lang") == "en", "official").otherwise("community").alias("authority"), T.token_estimate(F.col("text")).alias("token_estimate"), "source",
    )


def retrieval_metrics(spark, sf):
    """Relevant to an item: the labelled documents of good quality that hold it."""
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("p"))
    good = t(spark, sf, "labels").where("quality = 1").join(t(spark, sf, "documents"), "doc_id")
    rel = good.join(F.broadcast(b), F.contains("text", "p")).select("query_id", F.col("doc_id").alias("id")).distinct()
    ranked = bm25_or(spark, sf).withColumnRenamed("doc_id", "id")
    m = index.retrieval_metrics(ranked, rel, 3)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


def security_annotations(spark, sf):
    """Every document with the number of its lines' findings, and of its hidden blocks."""
    d = t(spark, sf, "documents")
    found = extract.security_annotations(d, "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("notes"))


def pitfall_scan(spark, sf):
    """Every document with the number of its pitfalls."""
    d = t(spark, sf, "documents")
    found = extract.extract_pitfalls(d.select("doc_id", F.col("text").alias("content")), "doc_id").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("pitfalls"))


def license_scan(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hit = d.where(F.lower("text").contains("license"))
    return hit.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.trim("text").alias("snippet"))


def html_title(spark, sf):
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return t(spark, sf, "pages").select("page_id", T.trimmed_title(T.unescape_html(raw)).alias("title"), T.slug(T.unescape_html(raw)).alias("slug"))


def html_links(spark, sf):
    p = t(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    links = p.select("page_id", U.resolved_link(F.col("href"), F.col("url")).alias("link")).where("link is not null")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("targets"), F.min("link").alias("first"))


def link_density(spark, sf):
    html = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), "(?s)<[^>]*>", "")
    linked = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), 1), "")
    return t(spark, sf, "pages").select("page_id", F.length(plain).cast("long").alias("chars"), F.length(linked).cast("long").alias("link_chars"), F.round(F.length(linked) / F.length(plain), 6).alias("density"))


def normalized_pages(spark, sf):
    n = markdown.normalize_pages(t(spark, sf, "pages"))
    return n.select("page_id", "title", T.content_hash(F.col("markdown")).alias("content_hash"), T.token_estimate(F.col("markdown")).alias("tokens"), F.size("headings").alias("headings"), F.size("links").alias("links"))


def page_chunks(spark, sf):
    c = markdown.slice_pages(markdown.normalize_pages(t(spark, sf, "pages")))
    return c.select("page_id", "ordinal", "chunk_id", "title", F.array_join("section_path", " > ").alias("path"), "chunk_type", "token_estimate", "content_hash")


def canonical_url(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


def url_dedupe(spark, sf):
    return canonical_url(spark, sf).groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def page_type(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return t(spark, sf, "pages").select("page_id", T.page_type(F.col("url"), title, F.regexp_replace("html", "(?s)<[^>]*>", " "), F.regexp_count(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/[^/]+"))).alias("page_type"))


def crawl_skip_reason(spark, sf):
    root = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit("/en/"))
    depth = F.pmod("page_id", F.lit(5))
    return t(spark, sf, "pages").select("page_id", F.coalesce(U.skip_reason(F.col("url"), root, depth), F.lit("")).alias("reason"))


def json_props(spark, sf):
    e = t(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.round(F.avg("value"), 6).alias("mean"), F.min("k").alias("least"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, exact_dedupe, source_stats, docs_map, paging, paragraph_chunks, chunk_edges, search_tokens, chunk_query_words, bm25_or, bm25_prefix, bm25_phrase, like_fallback, retrieval_metrics,
        security_annotations, pitfall_scan, license_scan, html_title, html_links, link_density, normalized_pages, page_chunks, canonical_url, url_dedupe, page_type, crawl_skip_reason, json_props,
    )
}

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '(?m)[ \t\f\x0B]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
_HASH = "sha256(" + _NORMAL.format("text") + ")"
_TOKENS = "CAST(ceil(length({0}) / 4.0) AS BIGINT)"
_WORDS = r"list_filter(string_split_regex(regexp_replace({0}, '[^A-Za-z0-9_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_GOOD = f"list_filter({_WORDS.format('text')}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, lower(w)))"
_SEARCH = f"CASE WHEN len({_GOOD}) > 0 THEN {_GOOD} ELSE list_filter({_WORDS.format('text')}, lambda w: length(w) >= 2) END"
_TERMS = r"regexp_extract_all(translate(lower({0}), '" + T.ACCENTED + "', '" + T.PLAIN + r"'), '([\p{{L}}\p{{N}}]+)', 1)"
_INTENT = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '(?i)(^|[^A-Za-z0-9_])({p})($|[^A-Za-z0-9_])') THEN '{n}'" for n, p in T.INTENTS) + " ELSE 'conceptual' END"
#: Times a phrase occurs in a line of terms parted by two spaces.
_TIMES = "CAST((length(s) - length(replace(s, ' ' || array_to_string(terms, '  ') || ' ', ''))) / length(' ' || array_to_string(terms, '  ') || ' ') AS BIGINT)"
_BM25 = f"""
WITH docs AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS term FROM docs),
lines AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS s FROM docs),
stats AS (SELECT count(*) AS n, avg(len(w)) AS al FROM docs),
units AS (SELECT item_id AS query_id, list_distinct({_SEARCH}) AS tokens FROM benchmark),
split AS (SELECT query_id, token, {_TERMS.format("token")} AS terms FROM (SELECT query_id, unnest(tokens) AS token FROM units)),
single AS (SELECT query_id, token, terms[1] AS term FROM split WHERE len(terms) = 1),
phrase AS (SELECT * FROM split WHERE len(terms) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM single) GROUP BY ALL),
hits AS (SELECT query_id, token, doc_id, tf FROM single JOIN tf USING (term) UNION ALL
  SELECT query_id, token, doc_id, tf FROM (SELECT query_id, token, doc_id, {_TIMES} AS tf FROM phrase, lines) WHERE tf > 0),
df AS (SELECT query_id, token, count(*) AS df FROM hits GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(w) / al))), 6) AS score FROM hits JOIN df USING (query_id, token) JOIN docs USING (doc_id), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scored)
"""
_UNESCAPE = "{0}"
for _seen, _meant in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_seen}', '{_meant}')"
_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_CANONICAL = r"""
parts AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS u FROM pages),
kept AS (SELECT page_id, u, list_filter(string_split(u.q, '&'), lambda x: x <> '' AND NOT list_contains([""" + ", ".join(f"'{x}'" for x in U.TRACKING) + r"""], split_part(x, '=', 1)) AND NOT starts_with(x, 'utm_')) AS q FROM parts),
canon AS (SELECT page_id, u.s || '://' || lower(u.h) || CASE WHEN u.p = '' THEN '/' ELSE regexp_replace(regexp_replace(u.p, '/+', '/', 'g'), '(.)/$', '\1') END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS url FROM kept)"""  # noqa: E501

def _quoted(pattern: str) -> str:
    """A rule's pattern for an engine without look-around: its word boundaries are ASCII ones."""
    return "'" + pattern.replace(T.LEFT, r"\b").replace(T.RIGHT, r"\b").replace("'", "''") + "'"


ORACLES = {
    "content_hash": f"SELECT doc_id, {_HASH} AS content_hash, {_TOKENS.format('text')} AS tokens FROM documents",
    "exact_dedupe": f"SELECT {_HASH} AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "source_stats": f"SELECT source, count(*) AS n, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY source",
    "docs_map": "SELECT source, CAST(sum(n) AS BIGINT) AS n, string_agg(e, ',' ORDER BY e) AS langs FROM (SELECT source, count(*) AS n, lang || ':' || count(*) || ':' || min(doc_id) || ':' || max(doc_id) AS e FROM documents GROUP BY source, lang) GROUP BY source",
    "paging": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
    "paragraph_chunks": f"""SELECT doc_id, count(*) AS chunks, CAST(sum({_TOKENS.format('p')}) AS BIGINT) AS tokens, CAST(max(i) - 1 AS BIGINT) AS last FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(p, ' ') <> '' GROUP BY doc_id""",
    "chunk_edges": "SELECT conv_id, turn, row_number() OVER w - 1 AS ordinal, coalesce(lead(turn) OVER w, -1) AS next, coalesce(lag(turn) OVER w, -1) AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "search_tokens": f"SELECT item_id, array_to_string({_SEARCH}, ' ') AS tokens, {_INTENT} AS intent FROM benchmark",
    "chunk_query_words": f"SELECT item_id, array_to_string({_WORDS.format('text')}, '|') AS words FROM benchmark",
    "bm25_or": _BM25 + "SELECT query_id, doc_id, score, position FROM ranked WHERE position <= 10",
    "bm25_prefix": f"""
WITH tokens AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({_SEARCH}, lambda w: length(w) >= 4))) AS token FROM benchmark),
one AS (SELECT query_id, token, terms[1] AS term FROM (SELECT *, {_TERMS.format("token")} AS terms FROM tokens) WHERE len(terms) = 1),
words AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
hits AS (SELECT query_id, token, doc_id, sum(n) AS tf FROM one JOIN counted ON left(counted.term, 3) = left(one.term, 3) AND starts_with(counted.term, one.term) GROUP BY ALL)
SELECT query_id, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM hits GROUP BY query_id""",
    "bm25_phrase": f"""
WITH lines AS (SELECT doc_id, ' ' || array_to_string({_TERMS.format("text")}, '  ') || ' ' AS s FROM documents), q AS (SELECT item_id AS query_id, {_TERMS.format("text")} AS terms FROM benchmark)
SELECT * FROM (SELECT query_id, doc_id, {_TIMES} AS tf FROM q, lines) WHERE tf > 0""",
    "like_fallback": "SELECT item_id AS query_id, count(*) AS docs FROM (SELECT item_id, lower(text) AS p FROM benchmark WHERE item_id % 2 = 0) JOIN documents ON contains(lower(text), p) GROUP BY 1",
    "retrieval_metrics": _BM25 + """,
rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) JOIN labels USING (doc_id) WHERE quality = 1),
top AS (SELECT query_id, doc_id, position, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM rel) AS hit FROM ranked WHERE position <= 3),
per AS (SELECT query_id, count(*) FILTER (hit) AS hits, count(*) AS shown, min(position) FILTER (hit) AS first FROM top GROUP BY 1),
totals AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1)
SELECT query_id, round(coalesce(hits / shown, 0.0), 6) AS precision, round(coalesce(hits / relevant, 0.0), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS reciprocal_rank FROM totals LEFT JOIN per USING (query_id)""",
    "security_annotations": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), n AS (SELECT doc_id, sum(" + " + ".join(f"CAST(regexp_matches(p, {_quoted(r[2])}) AS BIGINT)" for r in extract.LINE_RULES) + ") AS n FROM l GROUP BY 1) SELECT doc_id, CAST(coalesce(n, 0) + " + " + ".join(f"len(regexp_extract_all(text, {_quoted(r[1])}))" for r in extract.BLOCK_RULES) + " AS BIGINT) AS notes FROM documents LEFT JOIN n USING (doc_id)",
    "pitfall_scan": "SELECT doc_id, CAST(" + " + ".join(f"CAST(regexp_matches(text, {_quoted(r[2])}) AS BIGINT)" for r in extract.PITFALLS) + " AS BIGINT) AS pitfalls FROM documents",
    "license_scan": "SELECT doc_id, i AS line, trim(p, ' ') AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE contains(lower(p), 'license')",
    "html_title": rf"""WITH x AS (SELECT page_id, {_UNESCAPE.format(_TITLE)} AS r FROM pages)
SELECT page_id, trim(regexp_extract(r, '^(.*?)(?:\s[|\-–—]\s.*)?$', 1), ' ') AS title,
  regexp_replace(regexp_replace(regexp_replace(trim(lower(r), ' '), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-{{2,}}|^-+|-+$', '', 'g') AS slug FROM x""",
    "html_links": r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS h FROM pages),
l AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(o) || regexp_replace(h, '#.*$', ''), '\?.*$', ''), '(://[^/]+.+)/$', '\1'), '(://[^/]+)$', '\1/') AS link FROM a WHERE starts_with(h, '/'))
SELECT page_id, count(*) AS links, count(DISTINCT link) AS targets, min(link) AS first FROM l GROUP BY page_id""",
    "link_density": r"""WITH x AS (SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g')) AS chars,
  length(array_to_string(regexp_extract_all(html, '(?is)<a\s[^>]*>(.*?)</a>', 1), '')) AS link_chars FROM pages)
SELECT page_id, chars, link_chars, round(link_chars / chars, 6) AS density FROM x""",
    "canonical_url": "WITH " + _CANONICAL + " SELECT page_id, url FROM canon",
    "url_dedupe": "WITH " + _CANONICAL + " SELECT url, min(page_id) AS page_id, count(*) AS copies FROM canon GROUP BY url",
    "crawl_skip_reason": r"""WITH x AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS p FROM pages)
SELECT page_id, CASE WHEN NOT starts_with(p, '/en') THEN 'out_of_scope' WHEN page_id % 5 > 3 THEN 'depth' ELSE '' END AS reason FROM x""",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k, round(avg(value), 6) AS mean, min(CAST(props->>'k' AS BIGINT)) AS least FROM events GROUP BY event_type",
}
