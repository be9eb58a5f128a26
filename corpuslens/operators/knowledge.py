"""Searches of endpoints, examples and pitfalls, recipes, and implementation contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leading_method, search_tokens
from . import index


def entity_search(queries: DataFrame, rows: DataFrame, id_col: str, cols: list[str], limit: int, filters: Column | None = None, first: Column | None = None, pairs: Column | None = None, last: Column | None = None) -> DataFrame:
    """queries (query_id, query): BM25 over the columns, tokens of four and more letters as
    prefixes; queries without a hit fall back to rows that contain any token. `filters` on
    rows and `pairs` on rows with their query's other columns apply before the limit; `first`
    is an order that comes before the score, `last` one that comes after it."""
    kept = rows if filters is None else rows.where(filters)
    tokens = search_tokens(F.col("query"))
    hits = index.bm25(index.index_terms(kept, id_col, cols), index.query_units(queries, tokens, prefix_from=4))
    spare = index.any_token_fallback(queries, hits, kept, id_col, cols, tokens).withColumn("score", F.lit(0.0))
    found = hits.select("query_id", "id", "score").unionByName(spare.select("query_id", "id", "score"))
    named = found.join(kept.withColumnRenamed(id_col, "id"), "id")
    if pairs is not None:
        named = named.join(queries.drop("query"), "query_id").where(pairs)
    order = [c for c in (first, F.desc("score"), last, F.col("id")) if c is not None]
    return index.top_k(named, limit, *order).withColumnRenamed("id", id_col)


def version_or_null(version: str | None) -> Column:
    return F.lit(True) if version is None else (F.col("doc_version") == version) | F.col("doc_version").isNull()


def find_api(queries: DataFrame, endpoints: DataFrame, version: str | None = None, limit: int = 5) -> DataFrame:
    """A query such as `POST /x` asks for that method."""
    method, rest = leading_method(F.col("query"))
    q = queries.select("query_id", method.alias("want"), rest.alias("query"))
    rows = endpoints if "doc_version" in endpoints.columns else endpoints.withColumn("doc_version", F.lit(None).cast("string"))
    same = F.col("want").isNull() | (F.upper("method") == F.col("want"))
    return entity_search(q, rows, "endpoint_id", ["path", "summary"], limit, version_or_null(version), pairs=same)


def find_example(queries: DataFrame, examples: DataFrame, language: str | None = None, framework: str | None = None, limit: int = 5) -> DataFrame:
    same = F.lit(True)
    for c, v in (("language", language), ("framework", framework)):
        same = same if v is None else same & (F.lower(c) == v.lower())
    official = F.when(F.col("authority") == "official", 0).otherwise(1) if "authority" in examples.columns else None
    return entity_search(queries, examples, "example_id", ["task", "code"], limit, same, official)


def find_pitfall(queries: DataFrame, pitfalls: DataFrame, kind: str | None = None, version: str | None = None, limit: int = 5) -> DataFrame:
    same = version_or_null(version) if "doc_version" in pitfalls.columns else F.lit(True)
    return entity_search(queries, pitfalls, "pitfall_id", ["title", "content"], limit, same if kind is None else same & (F.col("kind") == kind), last=F.col("kind"))


def assemble_recipe(goal: str, chunks: list[dict], endpoints: list[dict], examples: list[dict], pitfalls: list[dict]) -> dict:
    """Ordered steps for a goal from a few rows found for it: setup, one step for each
    endpoint with an example that names it (each example once) and its warnings, then
    checks. What has no evidence is named as missing."""
    steps, missing, used = [], [], set()
    setup = [c for c in chunks if any(w in (c["title"] or "").lower() for w in ("install", "setup", "getting started", "prerequisite", "config"))]
    for c in setup[:2]:
        steps.append({"kind": "setup", "title": c["title"], "evidence": "documented", "source": c["chunk_id"]})
    for e in endpoints:
        name = f"{e['method']} {e['path']}"
        example = next((x for x in examples if x["example_id"] not in used and ((x.get("related_api") or "").endswith(e["path"]) or e["path"] in x["code"])), None)
        if example:
            used.add(example["example_id"])
        notes = [p["title"] for p in pitfalls if e["path"] in (p.get("content") or "")]
        steps.append({"kind": "call", "title": name, "evidence": "documented" if example else "inferred", "source": example["example_id"] if example else e["endpoint_id"], "code": example["code"] if example else None, "warnings": notes})
    for x in [x for x in examples if x["example_id"] not in used][: 0 if endpoints else 3]:
        used.add(x["example_id"])
        steps.append({"kind": "example", "title": x["task"], "evidence": "documented", "source": x["example_id"], "code": x["code"]})
    if endpoints:
        steps.append({"kind": "validate", "title": "Check responses and errors", "evidence": "inferred", "source": None})
    for found, what in ((endpoints, "endpoints"), (examples, "examples"), (chunks, "documentation")):
        if not found:
            missing.append(f"No {what} found for: {goal}")
    facts = sum(s["evidence"] == "documented" for s in steps)
    checks = [{"title": c["title"], "source": c["chunk_id"]} for c in chunks if any(w in (c["title"] or "").lower() for w in ("verify", "validat", "test", "check"))]
    needs = [{"title": c["title"], "source": c["chunk_id"]} for c in chunks if any(w in f"{c['title']} {c.get('content')}".lower() for w in ("prerequisite", "environment variable", "api key", "requires"))]
    confidence = recipe_confidence(facts, len(steps), bool(endpoints), bool(examples), bool(checks))
    return {"goal": goal, "steps": steps, "prerequisites": needs, "validation": checks, "missing_information": missing, "pitfalls": [p["title"] for p in pitfalls], "confidence": confidence}


#: What documented steps (by their share), endpoints, examples and documented checks add to a recipe's confidence.
CONFIDENCE = {"steps": 0.4, "endpoints": 0.3, "examples": 0.2, "checks": 0.1}


def recipe_confidence(facts: int, steps: int, endpoints: bool, examples: bool, checks: bool) -> float:
    if not facts:
        return 0.0
    return round(min(1.0, CONFIDENCE["steps"] * facts / steps + CONFIDENCE["endpoints"] * endpoints + CONFIDENCE["examples"] * examples + CONFIDENCE["checks"] * checks), 2)


def recipe(goal: str, spark, chunks: DataFrame, endpoints: DataFrame, examples: DataFrame, pitfalls: DataFrame, limit: int = 10) -> dict:
    """Four searches in Spark; the assembly reads at most 4 * limit rows (the limit is the feature)."""
    q = spark.createDataFrame([(0, goal)], "query_id long, query string")
    rows = lambda df: [r.asDict() for r in df.orderBy("position").collect()]
    return assemble_recipe(goal, rows(entity_search(q, chunks, "chunk_id", ["title", "content"], limit)), rows(find_api(q, endpoints, limit=limit)), rows(find_example(q, examples, limit=limit)), rows(find_pitfall(q, pitfalls, limit=limit)))


def context_text(found: dict, budget_tokens: int = 4000) -> str:
    """A recipe as Markdown, cut at about the budget (3.5 characters a token)."""
    out = [f"# {found['goal']}", ""]
    for i, s in enumerate(found["steps"], 1):
        out += [f"## {i}. {s['title']} ({s['evidence']})", *([f"```\n{s['code']}\n```"] if s.get("code") else []), *[f"> {w}" for w in s.get("warnings", [])]]
    out += ["", *[f"- missing: {m}" for m in found["missing_information"]]]
    text, most = "\n".join(out), int(budget_tokens * 3.5)
    return text if len(text) <= most else text[:most] + "\n... (truncated)"


def hints(endpoints: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """Endpoints with the titles of pitfalls that name their path."""
    few = F.broadcast(pitfalls.select("title", F.col("content").alias("_c")))
    j = endpoints.join(few, F.contains("_c", "path"), "left")
    return j.groupBy("method", "path").agg(F.array_sort(F.collect_set("title")).alias("pitfalls"))


def evaluation(results: DataFrame) -> DataFrame:
    """Per strategy: success and version rates, mean and upper median of tokens and latency."""
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return results.groupBy("strategy").agg(F.count("*").alias("tasks"), rate("success").alias("success"), rate("version_ok").alias("version_ok"), F.avg("tokens").alias("mean_tokens"), upper("tokens").alias("median_tokens"), F.avg("latency_ms").alias("mean_latency"), upper("latency_ms").alias("median_latency"))
