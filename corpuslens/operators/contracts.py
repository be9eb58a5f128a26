"""API contracts: endpoints of OpenAPI documents, calls in code, and their verification."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import short_id
from ..functions.urls import api_path
from .templates import fitting_templates

METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
PARAMETER = "struct<name:string,location:string,required:boolean,type:string>"
ENDPOINT_SCHEMA = (
    f"page_id string, method string, path string, summary string, deprecated boolean, parameters array<{PARAMETER}>, request_required array<string>, request_fields array<string>, "
    "response_fields array<string>, errors array<string>, auth array<string>, paginated boolean"
)
PAGING = ("page", "limit", "cursor", "offset", "per_page", "page_size", "starting_after", "ending_before")


def resolve_pointer(root: object, pointer: str) -> object:
    """What a local reference names, over chains of references; None for a cycle, an
    unknown target or another document."""
    seen = set()
    while pointer.startswith("#/") and pointer not in seen:
        seen.add(pointer)
        node = root
        for part in pointer[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(node, list) and part.isdigit() and int(part) < len(node):
                node = node[int(part)]
            elif isinstance(node, dict) and part in node:
                node = node[part]
            else:
                return None
        if not (isinstance(node, dict) and isinstance(node.get("$ref"), str)):
            return node
        pointer = node["$ref"]
    return None


def _deref(root: dict, node: object) -> dict:
    if isinstance(node, dict) and isinstance(node.get("$ref"), str):
        node = resolve_pointer(root, node["$ref"])
    return node if isinstance(node, dict) else {}


def _fields(root: dict, schema: object, depth: int = 0) -> tuple[dict, list]:
    """(properties, required) of a schema, allOf joined."""
    schema = _deref(root, schema)
    if schema.get("type") == "array" and depth < 3:
        return _fields(root, schema.get("items"), depth + 1)
    props, required = dict(schema.get("properties") or {}), list(schema.get("required") or [])
    for part in (schema.get("allOf") or []) if depth < 5 else []:
        p, r = _fields(root, part, depth + 1)
        props |= p
        required += r
    return props, [r for r in required if isinstance(r, str)]


def parse_openapi(spec: str | None) -> list[dict]:
    """Endpoints of an OpenAPI 3 or Swagger 2 document in JSON; none of anything else."""
    try:
        root = json.loads(spec or "")
    except ValueError:
        return []
    if not isinstance(root, dict) or not (root.get("openapi") or root.get("swagger")) or not isinstance(root.get("paths"), dict):
        return []
    out = []
    for path, item in root["paths"].items():
        item = _deref(root, item)
        for method in METHODS:
            op = item.get(method)
            if not isinstance(op, dict):
                continue
            merged: dict[tuple, dict] = {}
            body: object = None
            for raw in [*(item.get("parameters") or []), *(op.get("parameters") or [])]:
                p = _deref(root, raw)
                if p.get("in") == "body":
                    body = p.get("schema")
                elif p.get("name"):
                    kind = p.get("type") or _deref(root, p.get("schema")).get("type")
                    merged[p["name"], p.get("in")] = {"name": p["name"], "location": p.get("in"), "required": bool(p.get("required")), "type": kind}
            content = _deref(root, op.get("requestBody")).get("content") or {}
            if isinstance(content, dict) and content:
                body = (content.get("application/json") or next(iter(content.values())) or {}).get("schema")
            props, required = _fields(root, body) if body else ({}, [])
            answers, errors = {}, []
            for code, answer in (op.get("responses") or {}).items():
                answer = _deref(root, answer)
                if str(code).startswith("2"):
                    media = answer.get("content") or {}
                    schema = answer.get("schema") or ((media.get("application/json") or next(iter(media.values()), {})) or {}).get("schema")
                    answers |= _fields(root, schema)[0] if schema else {}
                elif str(code)[:1] in "45":
                    errors.append(str(code))
            security = op.get("security", root.get("security")) or []
            names = {p["name"] for p in merged.values()}
            out.append({
                "method": method.upper(), "path": path, "summary": op.get("summary") or op.get("description"), "deprecated": bool(op.get("deprecated")), "parameters": list(merged.values()),
                "request_required": sorted(set(required)), "request_fields": sorted(props), "response_fields": sorted(answers), "errors": sorted(errors),
                "auth": sorted({k for s in security if isinstance(s, dict) for k in s}), "paginated": bool(names & set(PAGING)) or bool({"has_more", "next_cursor", "next"} & set(answers)),
            })
    return out


def openapi_endpoints(pages: DataFrame, id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """Endpoints of the raw bodies, with endpoint_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in "page_id method path summary deprecated parameters request_required request_fields response_fields errors auth paginated".split()]
        for b in batches:
            yield pd.DataFrame([{"page_id": p} | e for p, s in zip(b["page_id"], b["body"]) for e in parse_openapi(s)], columns=names)

    found = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(body_col).alias("body")).mapInPandas(run, ENDPOINT_SCHEMA)
    return found.withColumn("endpoint_id", short_id(F.col("page_id"), F.col("method"), F.col("path")))


CALL_SCHEMA = "file string, method string, path string, fields array<string>, accessed array<string>, snippet string, line int, symbol string, ambiguous boolean"
#: SDK calls and the endpoints behind them.
SDK = (("stripe.webhookEndpoints.create", "POST", "/v1/webhook_endpoints"), ("stripe.charges.create", "POST", "/v1/charges"))
_KEY = re.compile(r"[{,]\s*[\"']?([A-Za-z0-9_-]+)[\"']?\s*:")
_READ = re.compile(r"(?:res(?:ponse)?(?:\.data)?|data|json|body|payload)\.([A-Za-z0-9_]+)")


def _keys(text: str | None) -> list[str]:
    try:
        return list(json.loads(text or ""))
    except (ValueError, TypeError):
        return [k for k in dict.fromkeys(_KEY.findall(text or "")) if k not in ("method", "headers", "body")]


def _object_at(code: str, at: int) -> str:
    """The balanced braces that open at or after a place in a call's arguments."""
    start = code.find("{", at)
    if start < 0 or re.search(r"[);\n]{2}", code[at:start]):
        return ""
    depth = 0
    for i in range(start, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if not depth:
            return code[start : i + 1]
    return code[start:]


def calls_in(code: str | None) -> list[dict]:
    """HTTP and SDK calls of JavaScript, Python and shell text."""
    code = code or ""
    strings = dict(re.findall(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*['\"`]([^'\"`]+)['\"`]", code))
    reads = [f for f in dict.fromkeys(_READ.findall(code)) if f not in ("json", "status", "headers", "data", "text")]
    out: list[dict] = []

    def add(m: re.Match, method: str | None, url: str | None, fields: list[str], accessed: list[str], symbol: str | None = None, ambiguous: bool = False) -> None:
        path = None if url is None else re.sub(r"^https?://[^/]*", "", url).split("?")[0] or "/"
        out.append({"method": method, "path": path, "fields": fields, "accessed": accessed, "snippet": m[0][:200], "line": code.count("\n", 0, m.start()) + 1, "symbol": symbol, "ambiguous": ambiguous})

    for m in re.finditer(r"(?<![\w.])fetch\s*\(\s*(?:['\"`]([^'\"`]+)['\"`]|([A-Za-z_$][\w$]*))\s*(,)?", code):
        url = m[1] or strings.get(m[2])
        options = _object_at(code, m.end()) if m[3] else ""
        how = re.search(r"method\s*:\s*['\"]([A-Za-z]+)", options)
        body = re.search(r"body\s*:", options)
        add(m, how[1].upper() if how else "GET", url, _keys(_object_at(options, body.end())) if body else [], reads, None, url is None)
    for m in re.finditer(r"(axios|requests)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*(,)?(?:\s*(?:json|data|params)\s*=)?", code):
        add(m, m[2].upper(), m[3], _keys(_object_at(code, m.end())) if m[4] else [], reads if m[1] == "axios" else [])
    for m in re.finditer(r"(?<!\w)curl\s+[^\n]*(?:\\\n[^\n]*)*", code):
        if url := re.search(r"https?://[^\s'\"]+", m[0]):
            how, data = re.search(r"-X\s*([A-Za-z]+)", m[0]), re.search(r"(?:-d|--data(?:-raw)?)\s+(['\"])(\{.*?\})\1", m[0], re.S)
            add(m, how[1].upper() if how else "POST" if re.search(r"\s(?:-d|--data)", m[0]) else "GET", url[0], _keys(data[2]) if data else [], [])
    for symbol, method, path in SDK:
        for m in re.finditer(re.escape(symbol) + r"\s*\(", code):
            add(m, method, path, _keys(_object_at(code, m.end())), [], symbol)
    if m := re.search(r"await\s+params\b", code):
        add(m, "GET", "nextjs/app_router/params", [], [], "nextjs_route_params_async")
    elif m := re.search(r"\}\s*=\s*params\b|\bparams\.[A-Za-z0-9_]+", code):
        add(m, "GET", "nextjs/app_router/params", [], [], "nextjs_route_params_sync")
    return out or [{"method": None, "path": None, "fields": [], "accessed": [], "snippet": code[:100], "line": 1, "symbol": None, "ambiguous": True}]


def extract_calls(files: DataFrame, file_col: str = "file", code_col: str = "code") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"file": f} | c for f, t in zip(b["file"], b["code"]) for c in calls_in(t)], columns=["file", "method", "path", "fields", "accessed", "snippet", "line", "symbol", "ambiguous"])

    return files.select(F.col(file_col).alias("file"), F.col(code_col).alias("code")).mapInPandas(run, CALL_SCHEMA)


def match_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls x endpoints whose path template fits, over a trie of the templates; `exact` tells
    the endpoints whose path is the call's own."""
    plain = lambda c: F.lower(F.regexp_replace(api_path(c), "/+$", ""))
    e = endpoints.select(*[F.col(x).alias("e_" + x) for x in endpoints.columns])
    fits = fitting_templates(calls.select("path"), endpoints.select(F.col("path").alias("template"))).select("path", F.col("template").alias("e_path"))
    found = calls.join(fits, "path").join(e, "e_path")
    return found.withColumn("exact", plain(F.col("path")) == plain(F.col("e_path")))


def verify_calls(calls: DataFrame, endpoints: DataFrame, pitfalls: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """Findings (file, line, rule, severity, detail): a call without evidence, an unknown
    path, a wrong method, a missing required parameter or field (once each), a deprecated
    endpoint, an undocumented response field, and the parameters rule of major version 15."""
    c = calls.withColumn("call", F.monotonically_increasing_id())
    route = F.coalesce(F.col("symbol").startswith("nextjs_route_params"), F.lit(False))
    finding = lambda rule, severity, detail: (F.col("file"), F.col("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))
    unclear = c.where("ambiguous").select(*finding("insufficient_evidence", "info", F.col("snippet")))
    plain = c.where(~F.col("ambiguous") & ~route)
    m = match_endpoints(plain, endpoints)
    unknown = plain.join(m.select("call").distinct(), "call", "left_anti").select(*finding("unknown_endpoint", "mismatch", F.concat_ws(" ", "method", "path")))
    ranked = m.withColumn("same", F.upper("method") == F.upper("e_method"))
    best = ranked.withColumn("rn", F.row_number().over(W.partitionBy("call").orderBy(F.desc("same"), F.desc("exact"), "e_path"))).where("rn = 1")
    wrong = best.where("not same").select(*finding("method_mismatch", "mismatch", F.concat_ws(" ", "method", "path")))
    ok = best.where("same")
    names = F.transform(F.filter("e_parameters", lambda p: p["required"] & ~p["location"].isin("path", "header")), lambda p: p["name"])
    missing = F.array_except(F.array_union(names, "e_request_required"), F.col("fields"))
    lacks = ok.select("*", F.explode(missing).alias("miss")).where(~F.contains("path", "miss")).select(*finding("missing_required", "mismatch", F.col("miss")))
    old = ok.where("e_deprecated").select(*finding("deprecated_endpoint", "warning", F.concat_ws(" ", "e_method", "e_path")))
    extra = ok.where(F.size("e_response_fields") > 0).select("*", F.explode(F.array_except("accessed", "e_response_fields")).alias("f")).select(*finding("undocumented_response_field", "warning", F.col("f")))
    out = unclear.unionByName(unknown).unionByName(wrong).unionByName(lacks).unionByName(old).unionByName(extra)
    newer = F.lit(version or "").rlike(r"(?:^|[^0-9])(?:1[5-9]|[2-9]\d)")
    sync = c.where((F.col("symbol") == "nextjs_route_params_sync") & newer).select(*finding("version_mismatch", "mismatch", F.lit("route parameters are asynchronous")))
    out = out.unionByName(sync)
    if pitfalls is not None:  # the first pitfall that names the call's path
        known = F.broadcast(pitfalls.select("title", "content", "related_api").where("related_api is not null"))
        hit = plain.join(known, F.contains("related_api", "path")).withColumn("rn", F.row_number().over(W.partitionBy("call").orderBy("title"))).where("rn = 1")
        out = out.unionByName(hit.select(*finding("pitfall", "warning", F.col("title"))))
    return out


def verdict(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: mismatch before warning before insufficient_evidence (only such findings)
    before verified; no findings are verified."""
    some = lambda s: F.coalesce(F.bool_or(F.col("severity") == s), F.lit(False))
    f = files.select("file").distinct().join(findings, "file", "left").groupBy("file").agg(some("mismatch").alias("m"), some("warning").alias("w"), some("info").alias("i"), F.count("rule").alias("n_findings"))
    return f.select("file", F.when(F.col("m"), "mismatch").when(F.col("w"), "warning").when(F.col("i"), "insufficient_evidence").otherwise("verified").alias("verdict"), "n_findings")


def endpoint_key() -> Column:
    return F.concat_ws(" ", F.upper("method"), "path")
