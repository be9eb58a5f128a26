"""Incremental ingestion (an extension): new raw pages flow from files through the same
normaliser and slicer into the store, one upsert a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, short_id, token_estimate
from ..functions.urls import canonical_url
from ..operators.markdown import chunk_edges, extract_symbols, normalize_pages, slice_pages
from ..sources.store import Store, latest, page_key

RAW_SCHEMA = "source_id string, url string, html string, fetched_at timestamp, doc_version string"


def pages_of(raw: DataFrame) -> DataFrame:
    """Canonical pages of raw ones; of equal addresses the last fetched."""
    r = latest(raw.withColumn("url", canonical_url(F.col("url"))), ["source_id", "url"], F.desc("fetched_at"), F.desc("html")).withColumn("page_id", page_key(F.col("source_id"), F.col("url")))
    n = normalize_pages(r)
    out = n.join(r.select("page_id", "source_id", "url", "fetched_at", "doc_version"), "page_id")
    return out.withColumns({"content_hash": content_hash(F.col("markdown")), "estimated_tokens": token_estimate(F.col("markdown"))})


def ingest_batch(raw: DataFrame, store: Store) -> None:
    """Pages, chunks, edges and symbols change together; what belonged to chunks that are gone goes with them."""
    with store.transaction():
        pages = store.upsert("pages", pages_of(raw))
        new = pages.join(raw.select(canonical_url(F.col("url")).alias("url")).distinct(), "url", "left_semi")
        stored = store.replace_children("chunks", new, slice_pages(new))
        mine = stored.join(new.select("page_id"), "page_id", "left_semi")
        store.upsert("chunk_edges", chunk_edges(mine))
        store.upsert("symbols", extract_symbols(mine).withColumn("symbol_id", short_id(F.col("chunk_id"), F.col("name"))))


def stream_pages(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files as they come, and all there are; a batch that is run again replaces its own rows."""
    raw = spark.readStream.schema(RAW_SCHEMA).parquet(folder)
    return raw.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by window and type with late rows up to a bound; for streams and batches."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
