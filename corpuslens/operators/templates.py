"""Which path template a path fits, by a trie that is joined level by level.

Templates are cut into segments; a segment such as `{id}` or `:id` is a wildcard. A node of
the trie is the beginning of some template, its edges go to the next segment. Paths walk
down together: at each level every path's nodes are joined with the edges of their next
segment and with the wildcard edges, both equi-joins, so a path meets only templates whose
beginning it fits, and no pattern is tried on a pair of path and template.

A segment that holds a wildcard and more (`{name}.json`) has a wildcard's edge, and what is
left of such templates is held against their pattern. A trie's depth is that of the deepest
template, and each level is written before the next.

Of the templates that a path fits the one with the longest beginning of literal segments
stays: at the first segment where two differ in kind the literal one wins. Templates that
are the same but for names of wildcards are one; the least of their texts stands for them.

Defined cases: queries, fragments and hosts are cut off, slashes at the end do not count,
letters are compared in any case, empty segments are segments, a wildcard takes no empty
one. A null path fits nothing, a null template is none. Repeated rows are matched each for
itself. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import api_path, path_pattern
from ..sources.scratch import written

#: Edges and ends of the trie beyond which they are shuffled and not broadcast (about 100 bytes each).
BROADCAST_EDGES = 100_000
WILDCARD = "*"
#: A segment that holds a wildcard, and one that is nothing else.
HOLDS, WHOLE = r"\{[^}]+\}|:[a-z0-9_]+", r"^(\{[^}]+\}|:[a-z0-9_]+)$"


def path_segments(path: Column) -> Column:
    """Segments of a path in small letters; a wildcard of a template keeps its braces."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(api_path(path), "[?#].*$", "")), "/+$", "")
    return F.split(F.regexp_replace(plain, "^/", ""), "/")


def template_segments(template: Column) -> Column:
    return F.transform(path_segments(template), lambda s: F.when(s.rlike(HOLDS), F.lit(WILDCARD)).otherwise(F.concat(F.lit("="), s)))


def template_trie(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """templates (template) -> (edges (node, label, child), ends (node, levels, template, partial)). A node is named by what leads to it."""
    cut = templates.select("template").where("template is not null").distinct().withColumn("s", template_segments(F.col("template")))
    name = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    each = cut.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    edges = each.select(F.concat(F.lit("/"), name(F.col("n") - 1)).alias("node"), F.element_at("s", F.col("n")).alias("label"), F.concat(F.lit("/"), name(F.col("n"))).alias("child"))
    partial = F.exists(path_segments(F.col("template")), lambda x: x.rlike(HOLDS) & ~x.rlike(WHOLE))
    ends = cut.select(F.concat(F.lit("/"), F.array_join("s", "/")).alias("node"), F.size("s").alias("levels"), "template", partial.alias("partial"))
    return edges.distinct(), ends


def fitting_templates(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """paths (path), templates (template) -> (path, template, kinds) of every distinct path and template that it fits;
    the template that fits best is the first by kinds."""
    edges, ends = (written(x, name) for x, name in zip(template_trie(templates), ("edges", "ends"), strict=True))
    hint = F.broadcast if edges.count() + ends.count() <= BROADCAST_EDGES else (lambda df: df)
    deepest = ends.agg(F.max("levels")).first()[0] or 0
    distinct = paths.select("path").where("path is not null").distinct().withColumn("s", path_segments(F.col("path")))
    walk = distinct.where(F.size("s") <= deepest).select("path", "s", F.lit("/").alias("node"), F.lit("").alias("kinds"))
    done = [walk.select("path", "node", "kinds").limit(0)]
    for level in range(deepest):
        here = F.get("s", F.lit(level))
        labels = F.when(here == "", F.array(F.lit("="))).otherwise(F.array(F.concat(F.lit("="), here), F.lit(WILDCARD)))
        step = walk.withColumn("label", F.explode(labels)).join(hint(edges), ["node", "label"])
        # literal before wildcard: kinds are compared as strings
        step = step.select("path", "s", F.col("child").alias("node"), F.concat("kinds", F.when(F.col("label") == WILDCARD, "w").otherwise("l")).alias("kinds"))
        step = written(step, "level")
        done.append(step.where(F.size("s") == level + 1).drop("s"))
        walk = step.where(F.size("s") > level + 1)
    found = reduce(DataFrame.unionByName, done).join(hint(ends), "node")
    plain = F.regexp_replace(F.regexp_replace(api_path(F.col("path")), "[?#].*$", ""), "/+$", "")
    return found.where(~F.col("partial") | F.regexp(plain, path_pattern(F.col("template")))).select("path", "template", "kinds")


def match_templates(paths: DataFrame, templates: DataFrame, path_col: str = "path") -> DataFrame:
    """All columns of paths and the template (null if none) that each fits best."""
    fits = fitting_templates(paths.select(F.col(path_col).alias("path")), templates)
    best = fits.groupBy(F.col("path").alias("_path")).agg(F.min(F.struct("kinds", "template"))["template"].alias("template"))
    return paths.join(best, paths[path_col] == best["_path"], "left").drop("_path")
