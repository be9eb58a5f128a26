"""Differences between two versions of a documentation, and where code feels them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def of_version(rows: DataFrame, version: str, or_null: bool = True) -> DataFrame:
    """Rows of a version; entities without one count for every version, chunks do not."""
    same = F.col("doc_version") == version
    return rows.where(same | F.col("doc_version").isNull()) if or_null else rows.where(same)


def last_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")


def diff_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(method, path, change): added, removed, deprecated or modified; an endpoint may be
    both deprecated and modified. Columns: method, path, deprecated, parameters,
    request_required and position, whose highest wins among equal keys."""
    cols = ["deprecated", "parameters", "request_required"]
    side = lambda d, s: last_by(d.withColumn("method", F.upper("method")), ["method", "path"], F.col("position")).select("method", "path", *[F.col(c).alias(s + c) for c in cols], F.lit(True).alias(s + "in"))
    j = side(old, "o_").join(side(new, "n_"), ["method", "path"], "full_outer")
    both = F.col("o_in").isNotNull() & F.col("n_in").isNotNull()
    changed = (F.sort_array("o_parameters") != F.sort_array("n_parameters")) | (F.sort_array("o_request_required") != F.sort_array("n_request_required"))
    kinds = F.array_compact(F.array(
        F.when(F.col("o_in").isNull(), F.lit("added")), F.when(F.col("n_in").isNull(), F.lit("removed")),
        F.when(both & F.col("n_deprecated") & ~F.col("o_deprecated"), F.lit("deprecated")), F.when(both & changed, F.lit("modified")),
    ))
    return j.select("method", "path", F.explode(kinds).alias("change"))


def diff_parameters(old: DataFrame, new: DataFrame) -> DataFrame:
    """(method, path, name, change) of endpoints that both versions have."""
    keys = old.select(F.upper("method").alias("method"), "path").intersect(new.select(F.upper("method").alias("method"), "path"))

    def params(d: DataFrame, s: str) -> DataFrame:
        d = d.withColumn("method", F.upper("method")).join(keys, ["method", "path"], "left_semi")
        p = d.select("method", "path", F.explode("parameters").alias("p")).select("method", "path", "p.name", F.col("p.required").alias(s + "req"), F.col("p.type").alias(s + "type"), F.lit(True).alias(s + "in"))
        return p.dropDuplicates(["method", "path", "name"])

    j = params(old, "o_").join(params(new, "n_"), ["method", "path", "name"], "full_outer")
    change = (
        F.when(F.col("o_in").isNull(), F.when(F.col("n_req"), "added_required").otherwise("added")).when(F.col("n_in").isNull(), "removed")
        .when(F.col("n_req") & ~F.col("o_req"), "now_required").when(~F.col("o_type").eqNullSafe(F.col("n_type")) & F.col("n_type").isNotNull(), "type_changed")
    )
    out = j.select("method", "path", "name", change.alias("change")).where("change is not null")

    def required(d: DataFrame, s: str) -> DataFrame:
        return d.withColumn("method", F.upper("method")).join(keys, ["method", "path"], "left_semi").select("method", "path", F.col("request_required").alias(s))

    b = required(old, "o").join(required(new, "n"), ["method", "path"])
    gone = b.select("method", "path", F.explode(F.array_except("o", "n")).alias("name"), F.lit("field_no_longer_required").alias("change"))
    more = b.select("method", "path", F.explode(F.array_except("n", "o")).alias("name"), F.lit("field_now_required").alias("change"))
    return out.unionByName(more).unionByName(gone)


def diff_pitfalls(old: DataFrame, new: DataFrame) -> DataFrame:
    key = ["kind", "title"]
    added = new.join(old.select(*key), key, "left_anti").select(*key, F.lit("added").alias("change"))
    return added.unionByName(old.join(new.select(*key), key, "left_anti").select(*key, F.lit("removed").alias("change")))


def diff_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(title, change); the last section of a title counts, and white space does not."""
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    side = lambda d, s: last_by(d, ["title"], F.col("ordinal")).select("title", flat.alias(s))
    j = side(old, "o").join(side(new, "n"), "title", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return j.select("title", change.alias("change")).where("change is not null")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


#: Fixed values: (category, certainty, confidence) of an endpoint's change.
IMPACT = {"removed": ("removed_api", "high", 0.95), "deprecated": ("deprecated_api", "high", 0.9), "modified": ("modified_parameters", "high", 0.85)}


def impact(files: DataFrame, endpoint_changes: DataFrame, pitfalls: DataFrame | None = None) -> DataFrame:
    """(file, line, snippet, pattern, category, certainty, confidence): lines of code that
    name a changed endpoint, or the symbol of a new pitfall. Changes are few and are
    broadcast; lines stream by."""
    lines = files.select("file", F.posexplode(F.split("code", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    bare = F.regexp_replace("path", "^/", "")
    some = endpoint_changes.where(F.col("change").isin(*IMPACT)).select("path", "change", bare.alias("bare"))
    named = F.contains("text", "path") | F.contains("text", F.concat(F.lit("'"), "bare", F.lit("'"))) | F.contains("text", F.concat(F.lit('"'), "bare", F.lit('"')))
    hits = lines.join(F.broadcast(some), named)
    pick = lambda i: F.coalesce(*[F.when(F.col("change") == k, F.lit(v[i])) for k, v in IMPACT.items()])
    out = hits.select("file", "line", F.trim("text").alias("snippet"), F.col("path").alias("pattern"), pick(0).alias("category"), pick(1).alias("certainty"), pick(2).alias("confidence"))
    if pitfalls is not None:
        p = F.broadcast(pitfalls.where("related_symbol is not null").select("related_symbol").distinct())
        more = lines.join(p, F.contains("text", "related_symbol"))
        out = out.unionByName(more.select("file", "line", F.trim("text").alias("snippet"), F.col("related_symbol").alias("pattern"), F.lit("breaking_pitfall").alias("category"), F.lit("heuristic").alias("certainty"), F.lit(0.5).alias("confidence")))
    return out
