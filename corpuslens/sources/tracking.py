"""Which documentation a project's dependencies have, which of them a query means, and whether a source is tracked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import resolve_versions
from .workspace import match_sources

#: Names that a query may use for a package.
ALIASES = {"nextjs": "next", "reactjs": "react", "vuejs": "vue"}


def query_names(query: Column) -> Column:
    """Lower-case words of two and more characters, and the packages they are other names of."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^\w\s-]", " "), r"\s+"), lambda w: F.length(w) > 1)
    also = F.array(*[F.when(F.array_contains(words, k), F.lit(v)) for k, v in ALIASES.items()])
    return F.array_union(words, F.array_compact(also))


def package_names(name: Column) -> Column:
    """What a query may call a package: its whole name, its name without scope, and parts of three and more letters."""
    low = F.lower(name)
    bare = F.regexp_replace(low, "^@[^/]+/", "")
    return F.array_union(F.array(low, bare), F.filter(F.split(bare, "[-_.]"), lambda p: F.length(p) > 2))


def meant_by(query: Column, name: Column) -> Column:
    return F.arrays_overlap(query_names(query), package_names(name))


def available_versions(deps: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(name, doc_version, snapshot_id, url, position): the snapshots of every source whose
    address names the dependency; of one version's snapshots that of most pages, then the first."""
    own = match_sources(deps, sources).select("name", "url", "source_id")
    held = own.join(snapshots, "source_id").withColumn("doc_version", F.coalesce(F.nullif("doc_version", F.lit("")), F.lit("latest")))
    best = held.groupBy("name", "doc_version").agg(F.max_by(F.struct("snapshot_id", "url", "position"), F.struct("page_count", -F.col("position"))).alias("s"), F.min("position").alias("first"))
    return best.select("name", "doc_version", "s.snapshot_id", "s.url", F.col("first").alias("position"))


def resolve_workspace(deps: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(name, version, doc_version, match_type, confidence, snapshot_id, url) of each dependency
    with documentation. snapshots: source_id, snapshot_id, doc_version, page_count, position.
    If no version fits, the first snapshot stands in."""
    known = available_versions(deps, sources, snapshots)
    projects = deps.select(F.col("name").alias("project"), "version").distinct().join(known.select(F.col("name").alias("project")).distinct(), "project", "left_semi")
    found = resolve_versions(projects, known.select(F.col("name").alias("project"), "doc_version", "position")).withColumnRenamed("project", "name")
    first = known.groupBy("name").agg(F.min_by(F.struct("snapshot_id", "url"), "position").alias("f"))
    fit = known.select("name", F.col("doc_version").alias("selected"), "snapshot_id", "url")
    out = found.join(fit, ["name", "selected"], "left").join(first, "name")
    return out.select("name", "version", F.col("selected").alias("doc_version"), "match_type", "confidence", F.coalesce("snapshot_id", "f.snapshot_id").alias("snapshot_id"), F.coalesce("url", "f.url").alias("url"))


def project_context(queries: DataFrame, lock: DataFrame | None, deps: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(query_id, from_lock, name, version, doc_version, match_type, confidence, snapshot_id): the
    first dependency that a query names. A lock, where there is one, decides alone; else the
    dependencies are resolved as they stand. lock: the columns of the result by `position`;
    deps: name, version, position."""
    columns = ["name", "version", "doc_version", "match_type", "confidence", "snapshot_id"]
    if lock is not None:
        rows = lock.select(*columns, "position")
    else:
        rows = resolve_workspace(deps, sources, snapshots).join(deps.groupBy("name", "version").agg(F.min("position").alias("position")), ["name", "version"]).select(*columns, "position")
    # both sides become rows of single words, so that names meet by an equi-join
    said = queries.select("query_id", F.explode(query_names(F.col("query"))).alias("word"))
    hits = said.join(rows.withColumn("word", F.explode(package_names(F.col("name")))), "word")
    best = hits.groupBy("query_id").agg(F.min_by(F.struct(*columns), F.struct("position", "name")).alias("m"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.lit(lock is not None).alias("from_lock"), "m.*")


def lock_keys(deps: DataFrame) -> DataFrame:
    """deps (folder, name, ...) with the key of its lock entry: the name, or folder and name if several folders have it."""
    many = F.count("*").over(W.partitionBy("name")) > 1
    return deps.withColumn("key", F.when(many & F.col("folder").isNotNull() & (F.col("folder") != "."), F.concat_ws(":", "folder", "name")).otherwise(F.col("name")))


def track_status(requests: DataFrame, tracked: DataFrame, sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(url, status) of sources that are to be tracked. requests: url, force and new_hash, the
    hash of what was fetched (null if not yet). A tracked source with a snapshot is
    already_tracked unless forced; fetched anew it is updated if its hash changed or it was
    forced; what was neither tracked nor captured is added. `fetch` says whether it has to be fetched."""
    latest = snapshots.groupBy("source_id").agg(F.max_by("snapshot_hash", F.struct("captured_at", "snapshot_id")).alias("old_hash"))
    have = sources.select("url", "source_id").join(latest, "source_id", "left").select("url", "old_hash")
    j = requests.join(tracked.select("url", F.lit(True).alias("tracked")).distinct(), "url", "left").join(have, "url", "left")
    known = F.coalesce("tracked", F.lit(False))
    settled = known & F.col("old_hash").isNotNull() & ~F.col("force")
    same = F.col("old_hash").eqNullSafe(F.col("new_hash")) & ~F.col("force")
    status = F.when(settled, "already_tracked").when(known | F.col("old_hash").isNotNull(), F.when(same, "already_tracked").otherwise("updated")).otherwise("added")
    return j.select("url", status.alias("status"), (~settled).alias("fetch"))
