"""URL verdicts: rules first, else a path-template tree.

Every path becomes a template: segments of digits, hexadecimal or mixed ids are
generalised at once. Per host the templates form a tree; level by level, a node whose
children are many and mostly different turns them into one wildcard, and children
whose labelled purity does not differ from their siblings' (two-proportion test) are
merged into one branch. A template is rejected if it holds labelled pages and their
purity, smoothed toward its host's and that toward the corpus's, reaches `reject_at`.

Labels are of pages, not of hosts: a page that a rule decides is labelled by its verdict,
and any other page by a table of labelled pages, so the branches of one host can differ.
`labels_by_text` makes such a table from labelled documents: a page carries the label of
the document that its main text is.

Counts are pre-aggregated by (host, template) before the tree is built. Levels go on as
deep as templates still branch. What is known of a node or template goes back by a
broadcast of checked size, else by a join that adaptive execution can split.

Defined cases: a null url, or one without `://`, has an empty host and path; a page
labelled both ways counts as both; purity equal to `reject_at` rejects; of rules that
fit equally long ones the last is taken; very long paths are read whole; repeated rows
are judged each; without labels nothing is rejected; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (verdict, rule) of the query's contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A node's children become a wildcard from so many different ones, if they are at least this share of its pages.
MANY_CHILDREN, DISTINCT_SHARE = 8, 0.5
#: Siblings within so many standard errors of the others' purity are one branch.
SIMILAR_Z = 1.96
SMOOTHING = 5.0
REJECT_AT = 0.5
BROADCAST_ROWS = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url as its text stands; no decoding."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path, identifiers generalised; a file suffix stays."""
    parts = F.array_remove(F.split(path, "/"), "")

    def general(s: Column) -> Column:
        stem, suffix = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = F.when(stem.rlike(r"^\d+$"), "{n}").when(stem.rlike(r"^(?=.*\d)[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*$"), "{hex}").when(stem.rlike(r"\d{3,}"), "{id}")
        return F.coalesce(F.concat(kind, suffix), s)

    return F.transform(parts, general)


def _known(df: DataFrame, name: str) -> DataFrame:
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _level(t: DataFrame, d: int) -> DataFrame:
    """Generalise and merge the children at depth d of templates
    (host, raw, segs, n, bad, good), where raw names the rows of the pages."""
    t = t.withColumn("prefix", F.array_join(F.slice("segs", 1, d), "/")).withColumn("child", F.get("segs", F.lit(d)))
    kids = t.where("child is not null").groupBy("host", "prefix", "child").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    nodes = kids.groupBy("host", "prefix").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")).where("k > 1")
    many = (F.col("k") >= MANY_CHILDREN) & (F.col("k") >= DISTINCT_SHARE * F.col("total"))
    nodes = _known(nodes.withColumn("many", many), f"nodes{d}")
    seen, others = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
    rate = (F.col("all_bad") + 0.5) / (F.col("all_bad") + F.col("all_good") + 1)
    gap = F.abs((F.col("bad") + 0.5) / (seen + 1) - (F.col("all_bad") - F.col("bad") + 0.5) / (others + 1))
    similar = gap <= SIMILAR_Z * F.sqrt(rate * (1 - rate) * (1 / (seen + 1) + 1 / (others + 1)))
    alike = kids.join(nodes.where("not many"), ["host", "prefix"]).where(similar).select("host", "prefix", "child", F.lit(True).alias("alike"))
    t = t.join(nodes.select("host", "prefix", "many"), ["host", "prefix"], "left").join(_known(alike, f"alike{d}"), ["host", "prefix", "child"], "left")
    wild = F.col("child").isNotNull() & (F.coalesce("many", F.lit(False)) | F.coalesce("alike", F.lit(False)))
    segs = F.when(wild, F.transform("segs", lambda s, i: F.when(i == d, F.lit("*")).otherwise(s))).otherwise(F.col("segs"))
    # from here on alike templates are one, but pages are still found by raw
    return stored(t.select("host", "raw", segs.alias("segs"), "n", "bad", "good"), f"level{d}")


def template_tree(labelled: DataFrame) -> DataFrame:
    """labelled: host, raw, bad, good (0 or 1 by page). Returns (host, raw) with its
    template, that template's labelled pages (bad, good) and its purity."""
    t = labelled.groupBy("host", "raw").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    t = stored(t.withColumn("segs", F.array_remove(F.split("raw", "/"), "")), "level")
    d = 0
    while True:  # as long as templates that begin alike still part
        here = t.where(F.size("segs") > d).select("host", "segs").distinct()
        begun = here.groupBy("host", F.array_join(F.slice("segs", 1, d), "/").alias("prefix")).agg(F.count("*").alias("k"))
        if not begun.where("k > 1").take(1):
            break
        t, d = _level(t, d), d + 1
    t = t.withColumn("template", F.concat(F.lit("/"), F.array_join("segs", "/")))
    whole = t.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = (whole[0] + 0.0) / max(1, whole[0] + whole[1])
    smooth = lambda bad, good, toward: (bad + SMOOTHING * toward) / (bad + good + SMOOTHING)
    hosts = t.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("good").alias("hg"))
    branch = t.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("good").alias("tg"))
    branch = branch.join(hosts, "host").withColumn("purity", smooth(F.col("tb"), F.col("tg"), smooth(F.col("hb"), F.col("hg"), F.lit(prior))))
    branch = _known(branch.select("host", "template", "tb", "tg", "purity"), "branch")
    return stored(t.select("host", "raw", "template").join(branch, ["host", "template"]), "templates")


def labels_by_text(
    pages: DataFrame, docs: DataFrame, labels: DataFrame, *, id_col: str = "page_id", text_col: str = "text", doc_id_col: str = "doc_id", doc_text_col: str = "text",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(page id, bad): pages whose main text is, with or without its first line (the
    heading), the text of a labelled document. A document is bad if its quality is 0 or
    it is toxic. pages: id and main text; texts are compared by the hash of their letters and digits."""
    key = lambda c: F.xxhash64(F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))))
    bad = F.when((F.col(quality_col) == 0) | (F.col(toxic_col) == 1), 1).when((F.col(quality_col) == 1) | (F.col(toxic_col) == 0), 0)
    known = labels.select(F.col(doc_id_col).alias("_id"), bad.alias("_bad")).where("_bad is not null and _id is not null").distinct()
    # hashed before the join, so that no text is shuffled; copies of one text may be labelled differently: every label counts once
    hashed = docs.where(F.col(doc_text_col).rlike(r"[\p{L}\p{N}]")).select(F.col(doc_id_col).alias("_id"), key(F.col(doc_text_col)).alias("key"))
    said = hashed.join(known, "_id").select("key", "_bad").distinct()
    text = F.col(text_col)
    body = F.substring(text, F.instr(text, "\n") + 1, F.length(text))  # the whole text if it has one line
    keys = pages.where(text.rlike(r"[\p{L}\p{N}]")).select(F.col(id_col), F.explode(F.array_distinct(F.array(key(text), key(body)))).alias("key"))
    return keys.join(said, "key").select(id_col, F.col("_bad").alias("bad")).distinct()


def judge_urls(
    pages: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad",
    rules: tuple[tuple[str, str], ...] = RULES, reject_at: float = REJECT_AT,
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template and purity.

    labelled: page ids and 1 (bad) or 0 (good)."""
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "_said": verdict, "raw": F.array_join(segments(F.col("path")), "/")})
    marked = p
    if labelled is None:
        marked = marked.withColumns({"_bad": F.lit(0).cast("long"), "_good": F.lit(0).cast("long")})
    else:
        votes = labelled.where(F.col(bad_col).isin(0, 1)).groupBy(F.col(id_col)).agg(F.max(bad_col).cast("long").alias("_bad"), F.max(1 - F.col(bad_col)).cast("long").alias("_good"))
        marked = marked.join(votes, id_col, "left")
    said = lambda word, column: F.when(F.col("_said").isNotNull(), (F.col("_said") == word).cast("long")).otherwise(F.coalesce(column, F.lit(0)))
    tree = template_tree(marked.select("host", "raw", said("block", "_bad").alias("bad"), said("allow", "_good").alias("good")))
    tree = F.broadcast(tree) if tree.count() <= BROADCAST_ROWS else tree
    out = p.join(tree, ["host", "raw"], "left")
    method = F.when((F.col("tb") + F.col("tg") > 0) & (F.col("purity") >= reject_at), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), "template", "purity")
