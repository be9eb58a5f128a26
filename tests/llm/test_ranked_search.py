"""Ranked search against a plain re-computation over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    kept = [(i, Counter(w), len(w)) for i, t in docs if (w := cut(t))]
    n_docs, n_terms = len(kept), sum(n for *_, n in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    queries = {}
    for i, t in dict.fromkeys(items):
        queries.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, q in queries.items():
        scored = []
        for i, c, n in kept:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in R.ranked_search(docs, items, **options).collect()), key=repr)


def corpus(rng):
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "日本", "a_b", "x-1", "DON'T"]
    say = lambda n: rng.choice([" ", "\n", ", ", "__"]).join(rng.choice(words[: rng.choice([5, 20, 67])]).title() for _ in range(n))
    docs = [(i, say(rng.choice([0, 1, 3, 30, 300]))) for i in range(200)]
    docs += [(i, docs[i % 7 + 20][1]) for i in range(200, 260)] + [(300, None), (301, " .,- "), (None, "w1 w2"), (5, "w1 again"), (5, "w1 again"), (400, "w3 " * 50_000)]
    items = [(i, say(rng.choice([1, 4, 12]))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w1 W1"), (33, "w1 w1 W1"), (34, "w1"), (34, "w2"), (None, "w4 w5")]
    return docs, items


@pytest.mark.parametrize("chunk,block", [(1 << 20, 16_000_000), (50, 16_000_000), (50, 400)])
def test_search(spark, monkeypatch, chunk, block):
    """Any chunk and any block of queries gives the same ranking; ties fall to the smaller id."""
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    monkeypatch.setattr(R, "CHUNK", chunk)
    docs, items = corpus(random.Random(chunk + block))
    d = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({"n": F.lit(1), "id": F.lit("x"), "terms": F.lit(2)})
    assert found(d, spark.createDataFrame(items, ITEMS).withColumn("item", F.lit(0))) == brute(docs, items)


def test_edges(spark):
    docs, items = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string"), spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r.item, r.rank, r.id) for r in R.ranked_search(docs, items, k=1).collect()] == [("q", 1, "a")]
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(" ")), items)):
        got = R.ranked_search(d, q)
        assert got.count() == 0 and got.columns == ["item", "rank", "id", "score"]


def test_radix_order():
    rng = np.random.default_rng(1)
    for bits in (1, 15, 16, 17, 40, 62):
        keys = rng.integers(0, 1 << bits, 5000)
        assert (R.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()
