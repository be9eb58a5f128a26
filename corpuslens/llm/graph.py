"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Nodes beyond which a round's minima are shuffled and not broadcast (16 bytes each and overhead: below 10 MB).
BROADCAST_ROWS = 200_000


def _minima(edges: DataFrame) -> DataFrame:
    """Smallest node around each u, itself included. Minima are pre-aggregated and joined
    back, so no neighbourhood is ever gathered in one row."""
    least = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return F.broadcast(least) if least.count() <= BROADCAST_ROWS else least


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, comp): the smallest id reachable, for every id with a link."""
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _minima(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = stored(small, "small")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
