"""Semantic versions as columns: parsing, ordering, ranges and the resolution ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VERSION = r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?"
#: Names of the newest documentation.
LATEST = ("latest", "stable", "current", "main", "default")


def clean_version(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[v=]", "")


def parse_version(c: Column) -> Column:
    """struct(major, minor, patch, release, pre), null if it is no version. Its natural
    order is that of versions: a prerelease comes before its release."""
    v = clean_version(c)
    part = lambda i: F.coalesce(F.regexp_extract(v, _VERSION, i).try_cast("long"), F.lit(0).cast("long"))
    pre = F.regexp_extract(v, _VERSION, 4)
    made = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").cast("int").alias("release"), pre.alias("pre"))
    return F.when(v.rlike(_VERSION), made)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; what is no version comes first, two of those by their text."""
    x, y = parse_version(a), parse_version(b)
    order = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    return F.when(x.isNull() & y.isNull(), order(a, b)).when(x.isNull(), -1).when(y.isNull(), 1).otherwise(order(x, y))


def _clause(version: Column, clause: Column) -> Column:
    v = parse_version(version)
    base = parse_version(F.regexp_replace(clause, r"^[\^~]", ""))
    same_major = v["major"] == base["major"]
    caret = same_major & F.when(base["major"] == 0, (v["minor"] == base["minor"]) & (v["patch"] >= base["patch"])).otherwise(
        (v["minor"] > base["minor"]) | ((v["minor"] == base["minor"]) & (v["patch"] >= base["patch"]))
    )
    tilde = same_major & (v["minor"] == base["minor"]) & (v["patch"] >= base["patch"])
    wild = r"^(\d+)(?:\.(\d+|\*|x))?(?:\.(\d+|\*|x))?$"  # the patch number does not count
    minor = F.regexp_extract(clause, wild, 2)
    wildcard = (v["major"] == F.regexp_extract(clause, wild, 1).try_cast("long")) & (minor.isin("", "*", "x") | (v["minor"] == minor.try_cast("long")))
    op, target = F.regexp_extract(clause, "^(>=|<=|>|<|=)(.+)$", 1), F.regexp_extract(clause, "^(>=|<=|>|<|=)(.+)$", 2)
    cmp = compare_versions(version, target)
    compared = F.when(op == ">=", cmp >= 0).when(op == "<=", cmp <= 0).when(op == ">", cmp > 0).when(op == "<", cmp < 0).otherwise(cmp == 0)
    equal = same_major & (v["minor"] == base["minor"]) & (v["patch"] == base["patch"])
    free = clause.isin("", "*", "x", "latest")
    out = F.when(free, True).when(clause.startswith("^"), caret).when(clause.startswith("~"), tilde).when(clause.rlike(wild), wildcard).when(op != "", compared).otherwise(equal)
    return F.coalesce(out & (free | v.isNotNull()), F.lit(False))


def satisfies(version: Column, range_: Column) -> Column:
    """Alternatives by ||, of clauses by spaces; an empty range, *, x and latest fit all."""
    any_of = F.split(F.coalesce(range_, F.lit("")), r"\|\|")
    clauses = lambda alt: F.split(F.trim(alt), r"\s+")
    return F.exists(any_of, lambda alt: F.forall(clauses(alt), lambda c: _clause(version, c)))


def resolve_versions(projects: DataFrame, available: DataFrame) -> DataFrame:
    """projects (project, version) x available (project, doc_version, position): the best
    documentation version on the ladder exact, major_minor, major, range, latest_fallback,
    unresolved; equal rungs go to the first listed."""
    j = projects.join(available, "project", "left")
    doc, pv = clean_version(F.col("doc_version")), F.coalesce(parse_version(F.col("version")), parse_version(F.regexp_replace("version", r"^[\^~=v><\s]+", "")))
    mm, major = F.concat_ws(".", pv["major"], pv["minor"]), pv["major"].cast("string")
    named = F.lower("doc_version").isin(*LATEST)
    rung = (
        F.when(F.col("doc_version").isNull(), 5)
        .when(doc == clean_version(F.col("version")), 0)
        .when(pv.isNotNull() & ((doc == mm) | (doc == F.concat(mm, F.lit(".x")))), 1)
        .when(pv.isNotNull() & ((doc == major) | (doc == F.concat(major, F.lit(".x"))) | (doc == F.concat(major, F.lit(".*")))), 2)
        .when(pv.isNotNull() & ~named & (satisfies(F.col("version"), F.col("doc_version")) | satisfies(F.col("doc_version"), F.col("version"))), 3)
        .otherwise(4)
    )
    j = j.withColumn("rung", rung)
    first = W.partitionBy("project", "version").orderBy("rung", F.when(F.col("rung") == 4, ~named).otherwise(False), "position")
    best = j.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    kind = F.element_at(F.array(*map(F.lit, ("exact", "major_minor", "major", "range", "latest_fallback", "unresolved"))), F.col("rung") + 1)
    trust = F.element_at(F.array(*map(F.lit, (1.0, 0.95, 0.9, 0.85, 0.5, 0.0))), F.col("rung") + 1)
    return best.select("project", "version", F.coalesce("doc_version", F.lit("unresolved")).alias("selected"), kind.alias("match_type"), trust.alias("confidence"))
