"""Rollups and Markdown exports of a corpus, in deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TOKENS = 150


def documentation_map(pages: DataFrame, chunks: DataFrame | None, endpoints: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """Per page: chunks, tokens, endpoints and pitfalls. Pages without chunks count their
    headings (one at least) and their own tokens (150 if unknown)."""
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    out = pages.join(count(endpoints, "endpoints"), "page_id", "left").join(count(pitfalls, "pitfalls"), "page_id", "left")
    if chunks is not None:
        out = out.join(chunks.groupBy("page_id").agg(F.count("*").alias("c"), F.sum("token_estimate").alias("t")), "page_id", "left")
    else:
        out = out.withColumns({"c": F.lit(None).cast("long"), "t": F.lit(None).cast("long")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "page_id", "title", "url", F.coalesce("c", F.greatest(F.lit(1), F.size("headings")).cast("long")).alias("chunks"), F.coalesce("t", "estimated_tokens", F.lit(PAGE_TOKENS)).alias("tokens"),
        zero("endpoints").alias("endpoints"), zero("pitfalls").alias("pitfalls"),
    ).orderBy("url")


def _lines(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """One row: the lines in order. A rendered document is small by nature."""
    return rows.select(F.struct(*[F.col(o) for o in order], line.alias("line")).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("body"))


def llms_txt(title: str, summary: str, pages: DataFrame) -> DataFrame:
    body = _lines(pages, F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise("")), "url")
    return body.select(F.concat(F.lit(f"# {title}\n\n> {summary}\n\n## Documentation\n\n"), "body", F.lit("\n")).alias("document"))


def agents_md(title: str, dependencies: DataFrame, endpoints: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """Dependencies, endpoints and pitfalls as an agent's instructions file."""
    parts = [
        ("Dependencies", _lines(dependencies, F.format_string("- %s %s (%s)", "name", "version", "ecosystem"), "ecosystem", "name")),
        ("API endpoints", _lines(endpoints, F.concat(F.lit("- `"), "method", F.lit(" "), "path", F.lit("` "), F.coalesce("summary", F.lit(""))), "path", "method")),
        ("Pitfalls", _lines(pitfalls, F.format_string("- **%s** %s", "kind", "title"), "kind", "title")),
    ]
    out = None
    for name, body in parts:
        one = body.select(F.lit(0).alias("k"), F.concat(F.lit(f"## {name}\n\n"), F.when(F.col("body") == "", "None recorded.").otherwise(F.col("body"))).alias(name))
        out = one if out is None else out.join(F.broadcast(one), "k")
    return out.select(F.concat(F.lit(f"# {title}\n\n"), F.concat_ws("\n\n", *[f"`{n}`" for n, _ in parts]), F.lit("\n")).alias("document"))


def claude_md(title: str, dependencies: DataFrame, endpoints: DataFrame, pitfalls: DataFrame, recipes: DataFrame) -> DataFrame:
    """The instructions file of a coding assistant: the agents' file with recipes (goal, step, title) after it."""
    steps = _lines(recipes, F.concat(F.lit("- "), "goal", F.lit(", step "), "step", F.lit(": "), "title"), "goal", "step")
    part = steps.select(F.lit(0).alias("k"), F.concat(F.lit("\n## Recipes\n\n"), F.when(F.col("body") == "", "None recorded.").otherwise(F.col("body")), F.lit("\n")).alias("more"))
    base = agents_md(title, dependencies, endpoints, pitfalls).withColumn("k", F.lit(0))
    return base.join(F.broadcast(part), "k").select(F.concat("document", "more").alias("document"))


def skill_md(name: str, description: str, pages: DataFrame) -> DataFrame:
    body = _lines(pages, F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")), "url")
    return body.select(F.concat(F.lit(f"---\nname: {name}\ndescription: {description}\n---\n\n# {name}\n\n"), "body", F.lit("\n")).alias("document"))


def write_document(document: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        f.write(document.first().document)
