"""Removal of lines that spread over many sites.

A line is its exact text; lines without a word are left alone. HyperLogLog sketches of
the sites of each line's hash are merged by aggregation. A line whose estimate is far
below `min_sites` stays, one far above is boilerplate, and lines near the threshold get
their exact count of distinct sites. A boilerplate line is removed everywhere but in
the document of smallest id that has it. Copies of one whole text count as one
document, at its smallest site: copying a document does not make its lines boilerplate.

Everything is DataFrame functions. Only 64-bit hashes of lines are shuffled, and whole
texts once, by id. Counting is pre-aggregated, so a frequent line is no hot key.

Defined cases: a null text stays null; lines of a null site count no site; a null id
is never cut; a line on exactly `min_sites` sites is removed, and of documents that share
it the one of smallest id keeps it; very long texts and lines are read whole; rows with the same id are cut alike, each in its own text; an emptied
text is an empty string; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly (the sketch's standard error is 1.6 %).
NEAR = 0.25
#: Lines to remove beyond which their table is shuffled and not broadcast (16 bytes each and overhead).
BROADCAST_ROWS = 1_000_000
HAS_WORD = r"[^\x20\x09-\x0D]"


def boilerplate_lines(docs: DataFrame, *, id_col: str, text_col: str, site_col: str, min_sites: int, lg_k: int = LG_K, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(hash, keeper) of the lines to remove, and the hashes of each document's lines."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(HAS_WORD))
    hashed = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("hashes"),
    )
    hashed = stored(hashed, "lines")
    texts = hashed.groupBy("t1", "t2").agg(F.min("site").alias("site"), F.min("id").alias("id"), F.first("hashes").alias("hashes"))
    each = stored(texts.select("id", "site", F.explode("hashes").alias("h")), "each")
    spread = each.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("id").alias("keeper"))
    spread = spread.select("h", "keeper", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - near))
    spread = stored(spread, "spread")
    close = spread.where(F.col("sites") <= min_sites * (1 + near))
    exact = each.join(close.select("h"), "h", "left_semi").distinct().groupBy("h").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites * (1 + near)).select("h", "keeper")
    return stored(sure.unionByName(close.join(exact, "h").select("h", "keeper")), "boilerplate"), hashed


def remove_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the text cut, and n_lines and n_removed after its columns, which come
    packed in `_row` as they were: select what is wanted."""
    bad, hashed = boilerplate_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    hits = hashed.select("id", F.explode("hashes").alias("h")).join(bad, "h").where("id != keeper")
    cut = stored(hits.groupBy("id").agg(F.collect_set("h").alias("cut")), "cut")  # at most the lines of one document
    # rows without an id match nothing: a salt keeps them from meeting in one task
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), salt.alias("_salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(cut.withColumn("_salt", F.lit(0).cast("long")).hint("merge"), ["id", "_salt"], "left")  # one plan at every size
    text = F.col("_row").getField(text_col)
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(HAS_WORD) & F.array_contains("cut", F.xxhash64(x))))
    rows = rows.withColumn("_kept", F.when(F.col("cut").isNotNull(), kept))
    return rows.select(
        "_row", F.coalesce(F.array_join("_kept", "\n"), text).alias("text"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("cut").isNotNull(), F.size(F.split(text, "\n")) - F.size("_kept")).otherwise(0).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """docs, same columns: the text cut and its length, if such a column exists, anew."""
    cut = remove_boilerplate(docs, text_col=text_col, **options)
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        if c == text_col:
            old = F.col("text")
        elif c == chars_col:
            old = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old).cast(docs.schema[c].dataType)
        out.append(old.alias(c))
    return cut.select(*out)
