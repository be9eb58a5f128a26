"""Lookups by id or address, optional filters, and rollups of an ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clipped

#: Characters of a chunk and of a page that a lookup shows.
CHUNK_CHARS, PAGE_CHARS = 10_000, 30_000


def matching_chunks(chunks: DataFrame, snapshot_id: str | None = None, chunk_type: str | None = None, doc_version: str | None = None) -> DataFrame:
    """Chunks that fit every filter that is given."""
    for column, value in (("snapshot_id", snapshot_id), ("chunk_type", chunk_type), ("doc_version", doc_version)):
        chunks = chunks if value is None else chunks.where(F.col(column) == value)
    return chunks


def of_chunks(rows: DataFrame, chunks: DataFrame, key: str, fields: list[str], name: str, order: list[str]) -> DataFrame:
    """(chunk_id, name): the children of the given chunks, one sorted array a chunk."""
    some = rows.join(chunks.select(F.col("chunk_id").alias(key)).distinct(), key, "left_semi")
    packed = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return some.groupBy(F.col(key).alias("chunk_id")).agg(packed.alias(name))


def symbols_by_chunk(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    return of_chunks(symbols, chunks, "chunk_id", ["name", "kind"], "symbols", ["name"])


def get_documents(requests: DataFrame, chunks: DataFrame, pages: DataFrame, symbols: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """requests (request_id, id): a chunk id, page id or address -> request_id, found (chunk,
    page or none), id, title, content (cut at a limit), and its symbols, edges or links.
    Children are fetched by semi joins of what was found."""
    asked = requests.select("request_id", F.trim("id").alias("asked"))
    c = asked.join(chunks, F.col("asked") == F.col("chunk_id")).select("request_id", F.lit("chunk").alias("found"), F.col("chunk_id").alias("id"), "title", clipped(F.col("content"), CHUNK_CHARS).alias("content"))
    rest = asked.join(c.select("request_id"), "request_id", "left_anti")
    by = lambda key: rest.join(pages, F.col("asked") == F.col(key)).select("request_id", F.lit("page").alias("found"), F.col("page_id").alias("id"), "title", clipped(F.col("markdown"), PAGE_CHARS).alias("content"))
    hit = c.unionByName(by("page_id")).unionByName(by("url"))
    none = asked.join(hit.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("none").alias("found"), F.col("asked").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"))
    here = hit.where("found = 'chunk'").select(F.col("id").alias("chunk_id"))
    with_children = hit.withColumnRenamed("id", "chunk_id").join(symbols_by_chunk(symbols, here), "chunk_id", "left").join(of_chunks(edges, here, "src", ["type", "dst"], "edges", ["type", "dst"]), "chunk_id", "left")
    page_links = of_chunks(links, hit.where("found = 'page'").select(F.col("id").alias("chunk_id")), "page_id", ["url", "text"], "links", ["url"])
    out = with_children.join(page_links, "chunk_id", "left").withColumnRenamed("chunk_id", "id")
    return out.unionByName(none, allowMissingColumns=True)


def sources_with_snapshots(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every source with its snapshots, the newest first."""
    own = snapshots.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("captured_at", "snapshot_id", "doc_version", "page_count")), asc=False).alias("snapshots"))
    empty = F.array().cast(own.schema["snapshots"].dataType)
    return sources.join(own, "source_id", "left").withColumn("snapshots", F.coalesce("snapshots", empty))


def by_keywords(links: DataFrame, keywords: list[str]) -> DataFrame:
    """Links with the number of keywords that their address or title holds; position orders by it, then by their own order."""
    held = lambda k: (F.lower("url").contains(k.lower()) | F.lower("title").contains(k.lower())).cast("long")
    scored = links.withColumn("overlap", sum((held(k) for k in keywords), F.lit(0).cast("long")))
    return scored.orderBy(F.desc("overlap"), "ordinal")


def ingestion_stats(pages: DataFrame, discovered: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals; pages: raw_bytes, estimated_tokens, n_code, n_alerts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    p = pages.agg(F.count("*").alias("pages"), total("raw_bytes").alias("bytes"), total("estimated_tokens").alias("tokens"), total("n_code").alias("code_examples"), F.count_if(F.col("n_alerts") > 0).alias("pages_with_alerts"))
    d = discovered.agg(F.count_if((F.col("status") == "valid") & F.col("machine_readable")).alias("machine_readable_sources"))
    c = chunks.agg(F.count("*").alias("chunks"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(p).join(F.broadcast(one(d)), "_one").join(F.broadcast(one(c)), "_one").drop("_one")


def inspection(discovered: DataFrame) -> DataFrame:
    """What was found: counts, and which kinds of valid sources there are."""
    valid = F.col("status") == "valid"
    has = lambda kind: F.coalesce(F.bool_or(valid & (F.col("type") == kind)), F.lit(False)).alias(f"has_{kind}")
    return discovered.agg(
        F.count("*").alias("found"), F.count_if(valid & F.col("machine_readable")).alias("machine_readable"), F.count_if(valid & (F.col("authority") == "official")).alias("official"),
        *map(has, ("openapi", "llms_txt", "llms_full_txt", "skill", "sitemap")),
    )


def first_by(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Distinct values of a key with the first row of each, in order of their first place."""
    held = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return held.select(key, "r.*")
