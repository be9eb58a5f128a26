"""Scores of documentation sources by purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weight of a source type for a purpose.
PURPOSES = {
    "navigation": {"llms_txt": 1.0, "sitemap": 0.9, "web": 0.7, "llms_full_txt": 0.6, "markdown": 0.5, "skill": 0.45, "openapi": 0.4, "github": 0.3},
    "conceptual": {"llms_txt": 0.85, "sitemap": 0.3, "web": 0.75, "llms_full_txt": 0.95, "markdown": 1.0, "skill": 0.6, "openapi": 0.5, "github": 0.45},
    "api": {"llms_txt": 0.4, "sitemap": 0.2, "web": 0.5, "llms_full_txt": 0.65, "markdown": 0.7, "skill": 0.3, "openapi": 1.0, "github": 0.35},
    "examples": {"llms_txt": 0.45, "sitemap": 0.2, "web": 0.6, "llms_full_txt": 0.8, "markdown": 0.85, "skill": 0.5, "openapi": 0.4, "github": 1.0},
    "implementation": {"llms_txt": 0.85, "sitemap": 0.2, "web": 0.65, "llms_full_txt": 0.8, "markdown": 0.9, "skill": 1.0, "openapi": 0.6, "github": 0.55},
}
AUTHORITIES = {"official": 1.0, "community": 0.8, "third_party": 0.6}


def source_score(purpose: str) -> Column:
    weight = F.lit(0.4)
    for kind, w in PURPOSES[purpose].items():
        weight = F.when(F.col("type") == kind, w).otherwise(weight)
    trust = F.lit(0.6)
    for name, w in AUTHORITIES.items():
        trust = F.when(F.col("authority") == name, w).otherwise(trust)
    score = (weight * trust + F.when(F.col("machine_readable"), 0.05).otherwise(0.0)) * F.col("confidence")
    return F.when(F.col("status") == "unreachable", 0.0).when(F.col("status") == "invalid", 0.05).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def rank_sources(sources: DataFrame, purposes: tuple[str, ...] = tuple(PURPOSES)) -> DataFrame:
    """Each source's score and rank for each purpose; recommended is the first valid one."""
    each = None
    for p in purposes:
        one = sources.select("url", "status", F.lit(p).alias("purpose"), source_score(p).alias("score"))
        each = one if each is None else each.unionByName(one)
    ranked = each.withColumn("position", F.row_number().over(W.partitionBy("purpose").orderBy(F.desc("score"), "url")))
    first = F.min(F.when(F.col("status") == "valid", F.col("position"))).over(W.partitionBy("purpose"))
    return ranked.select("purpose", "url", "score", "position", F.coalesce(F.col("position") == first, F.lit(False)).alias("recommended"))
