"""Groups of equal texts against a plain re-computation, with hashes that collide too."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup
from corpuslens.llm.exact_dedup import drop_copies, exact_groups

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = {}
    normal = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        own = groups[normal(t)]
        best = min(own, key=lambda x: x[:3])
        out.append((i, best[3], len(own), (-len(t or ""), i) == (best[0], best[3]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(rng, n):
    base = ["", " ", "a", "A", "é x", "a b c d", " nbsp", "ab c", "x" * 5000, None]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if t and rng.random() < 0.7:
            t = "".join(c + rng.choice(["", "", " ", "\n", "\t\r", "\x0b\x0c"]) for c in t)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("key", [exact_dedup.hash_128, lambda sha: F.substring(sha, 1, 1).cast("binary"), lambda sha: F.lit(b"one"), lambda sha: F.lit(None).cast("binary")])
def test_groups(spark, key):
    """Bytes decide: a hash of four bits, or of none, gives the same groups."""
    rng = random.Random(3)
    rows = made(rng, 300) + [(None, "a b"), (None, None), (7, "repeated"), (7, "repeated"), (8, "re peated")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"h": F.lit(1), "rank": F.lit("x"), "normal": F.lit(2.0)})
    got = sorted((tuple(r) for r in exact_groups(df, key=key).collect()), key=repr)
    assert got == brute(rows)


def test_shuffled_plan(spark, monkeypatch):
    """Beyond the bound of a broadcast the same rows come."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    rows = made(random.Random(4), 200)
    assert sorted((tuple(r) for r in exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0
    long = "word " * 400_000
    rows = [("b", long), ("a", long), ("c", long.replace(" ", ""))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect()}
    assert got == {"a": ("a", 3, True), "b": ("a", 3, False), "c": ("a", 3, False)}
    assert [r.doc_id for r in drop_copies(df).collect()] == ["a"]


def test_no_python(spark):
    rows = made(random.Random(5), 50)
    plan = exact_groups(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
