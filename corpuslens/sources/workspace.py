"""Manifests and lock files of a workspace as dependency rows.

Files are read by Spark (path filter, recursive); each manifest becomes rows by a
parser of its own format. Lock versions come by left joins.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.substrings import containing

SCHEMA = "file string, ecosystem string, name string, range string, dev boolean, lock boolean"
IGNORED = r"/(?:node_modules|\.git|dist|build|vendor|target|\.venv|__pycache__)/"
Row = tuple[str, str | None, bool]


def _json(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _table(found: dict, dev: bool) -> Iterator[Row]:
    for name, v in (found or {}).items():
        yield name, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, dev


def npm(text: str) -> Iterator[Row]:
    d = _json(text)
    for key in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        yield from _table(d.get(key) or {}, key == "devDependencies")


def npm_lock(text: str) -> Iterator[Row]:
    d = _json(text)
    for path, v in (d.get("packages") or {}).items():
        if path.startswith("node_modules/") and "node_modules/" not in path[13:]:
            yield path[13:], v.get("version"), False
    if not d.get("packages"):
        yield from _table(d.get("dependencies") or {}, False)


def cargo(text: str) -> Iterator[Row]:
    d = _toml(text)
    for key in ("dependencies", "dev-dependencies", "build-dependencies"):
        yield from _table(d.get(key) or {}, key == "dev-dependencies")


def toml_packages(text: str) -> Iterator[Row]:
    for p in _toml(text).get("package") or []:
        yield p.get("name"), p.get("version"), False


def go(text: str) -> Iterator[Row]:
    for block in re.findall(r"require\s*\(([^)]*)\)", text) + re.findall(r"(?m)^require\s+([^(\n]+)$", text):
        for name, version in re.findall(r"(?m)^\s*([\w./~-]+)\s+(v[\w.+-]+)", block):
            yield name, version, False


_PIP = re.compile(r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")


def _pip(line: str, dev: bool = False) -> Iterator[Row]:
    if (m := _PIP.match(line)) and not line.lstrip().startswith("-"):
        yield m[1].lower(), m[2].strip() or "*", dev


def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            yield from _pip(line)


def pyproject(text: str) -> Iterator[Row]:
    d = _toml(text)
    for line in d.get("project", {}).get("dependencies") or []:
        yield from _pip(line)
    for group in (d.get("project", {}).get("optional-dependencies") or {}).values():
        for line in group:
            yield from _pip(line, True)
    poetry = d.get("tool", {}).get("poetry", {})
    yield from (r for r in _table(poetry.get("dependencies") or {}, False) if r[0] != "python")
    yield from _table(poetry.get("dev-dependencies") or {}, True)


def composer(text: str) -> Iterator[Row]:
    d = _json(text)
    for key in ("require", "require-dev"):
        yield from (r for r in _table(d.get(key) or {}, key == "require-dev") if "/" in r[0])


def gemfile(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text):
        yield name, version or "*", False


def pubspec(text: str) -> Iterator[Row]:
    section = None
    for line in text.splitlines():
        if m := re.match(r"^(\w+):\s*$", line):
            section = m[1]
        elif section in ("dependencies", "dev_dependencies") and (m := re.match(r"^  (\w+):\s*(.*?)\s*$", line)):
            yield m[1], m[2].strip("'\"") or None, section == "dev_dependencies"


def pom(text: str) -> Iterator[Row]:
    for block in re.findall(r"(?s)<dependency>(.*?)</dependency>", text):
        get = lambda tag: (re.search(rf"<{tag}>\s*([^<]+?)\s*</{tag}>", block) or [None, None])[1]
        if get("groupId") and get("artifactId"):
            yield f"{get('groupId')}:{get('artifactId')}", get("version"), get("scope") == "test"


#: File name -> (ecosystem, parser, is a lock file). More can be added.
PARSERS: dict[str, tuple[str, Callable[[str], Iterator[Row]], bool]] = {
    "package.json": ("npm", npm, False), "package-lock.json": ("npm", npm_lock, True), "Cargo.toml": ("cargo", cargo, False), "Cargo.lock": ("cargo", toml_packages, True), "go.mod": ("go", go, False),
    "requirements.txt": ("pypi", requirements, False), "pyproject.toml": ("pypi", pyproject, False), "poetry.lock": ("pypi", toml_packages, True), "composer.json": ("composer", composer, False),
    "Gemfile": ("rubygems", gemfile, False), "pubspec.yaml": ("pub", pubspec, False), "pom.xml": ("maven", pom, False),
}


def read_files(spark: SparkSession, folder: str, pattern: str = "*", max_depth: int | None = None) -> DataFrame:
    """(file, code) of a tree, build and package folders left out."""
    f = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("code"))
    f = f.where(~F.col("file").rlike(IGNORED))
    if max_depth is not None:
        root = F.size(F.split(F.lit(re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))), "/"))
        f = f.where(F.size(F.split(F.regexp_replace("file", r"^[a-z]+:/*", "/"), "/")) - root <= max_depth + 1)
    return f


def parse_manifests(files: DataFrame) -> DataFrame:
    """files (file, code) -> file, ecosystem, name, range, dev, lock."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, code in zip(b["file"], b["code"]):
                if kind := PARSERS.get(file.rsplit("/", 1)[-1]):
                    rows += [(file, kind[0], n, v, d, kind[2]) for n, v, d in kind[1](code or "")]
            yield pd.DataFrame(rows, columns=["file", "ecosystem", "name", "range", "dev", "lock"])

    return files.select("file", "code").mapInPandas(run, SCHEMA)


def dependencies(files: DataFrame) -> DataFrame:
    """Direct dependencies with the version their folder's lock file fixes."""
    rows = parse_manifests(files).withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    locks = rows.where("lock").groupBy("folder", "ecosystem", "name").agg(F.max("range").alias("locked"))
    return rows.where("not lock").join(locks, ["folder", "ecosystem", "name"], "left").select("file", "ecosystem", "name", "range", "dev", F.coalesce("locked", F.regexp_replace("range", r"^[\^~=v><\s]+", "")).alias("version"))


def match_sources(deps: DataFrame, sources: DataFrame) -> DataFrame:
    """Documentation sources whose address holds the dependency's name, with its scope or without, in any case, or whose
    own name (column metadata_name, if there is one) is the name without its scope."""
    bare = F.lower(F.regexp_replace("name", "^@[^/]+/", ""))
    names = deps.select("name", F.explode(F.array_distinct(F.array(bare, F.lower("name")))).alias("pattern")).where("pattern <> ''").distinct()
    found = containing(sources.select(F.col("url").alias("id"), F.lower("url").alias("text")).distinct(), names).select("name", F.col("id").alias("url"))
    if "metadata_name" in sources.columns:
        own = deps.select("name", bare.alias("bare")).distinct()
        found = found.unionByName(sources.join(own, F.lower("metadata_name") == F.col("bare")).select("name", "url"))
    return found.distinct().join(sources, "url").select("name", "url", *[c for c in sources.columns if c != "url"])


def lock_document(deps: DataFrame, resolved: DataFrame, previous: dict | None = None, now: str = "") -> dict:
    """docs.lock: sorted; the time stays if nothing else changed. One row a dependency."""
    rows = deps.join(resolved, (deps.name == resolved.project) & (deps.version == resolved.version), "left").select(deps.ecosystem, deps.name, deps.version, "selected", "match_type", "confidence").distinct()
    entries = [r.asDict() for r in rows.orderBy("ecosystem", "name", "version").toLocalIterator()]
    if previous and previous.get("dependencies") == entries:
        return previous
    return {"version": 1, "generated_at": now, "dependencies": entries}


def write_lock(path: str, lock: dict) -> None:
    with open(path, "w") as f:
        f.write(json.dumps(lock, indent=2, sort_keys=True) + "\n")


def read_lock(path: str) -> dict | None:
    try:
        with open(path) as f:
            found = _json(f.read())
    except OSError:
        return None
    return found if found.get("version") == 1 else None
