"""Substring join, template trie, link tree and snapshots against plain re-computations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import substrings, templates
from corpuslens.sources import linktree, merkle


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_containing(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_GRAMS", block)
    rng = random.Random(block)
    say = lambda n: "".join(rng.choice("abé 日\n") for _ in range(n))
    texts = [(i, say(rng.choice([0, 1, 5, 40, 200]))) for i in range(120)] + [(200, None), (3, "twice"), (3, "twice"), (300, "a" * 100_000 + "needle in a haystack")]
    found = [t for _, t in texts if t and len(t) > 12]
    pats = [(i, p) for i, p in enumerate([*(t[3 : 3 + rng.choice([1, 2, 3, 5, 9])] for t in found[:30]), "a", "é", "", None, "nowhere at all", "needle in", "twice", "twice"])]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(pats, "n long, pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, n, p) for i, t in texts if t for n, p in pats if p and p in t)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containing_nothing(spark):
    texts, pats = spark.createDataFrame([(1, "x")], "id long, text string"), spark.createDataFrame([("x",)], "pattern string")
    assert substrings.containing(texts.limit(0), pats).count() == 0 and substrings.containing(texts, pats.limit(0)).count() == 0


def best_template(path, known):
    if path is None:
        return None
    cut = lambda p: re.sub(r"/+$", "", re.sub(r"[?#].*", "", re.sub(r"^https?://[^/?#]*", "", p.strip()).lower())).removeprefix("/").split("/")
    wild = lambda s: bool(re.fullmatch(r"\{[^}]+\}|:[a-z0-9_]+", s))
    fits = []
    for t in known:
        a, b = cut(path), cut(t)
        if len(a) == len(b) and all((wild(y) and x != "") or x == y for x, y in zip(a, b)):
            fits.append(("".join("w" if wild(y) else "l" for y in b), t))
    return min(fits)[1] if fits else None


def test_templates(spark):
    rng = random.Random(4)
    seg = ["a", "B", "users", "7", "v1", ""]
    known = ["/" + "/".join(rng.choice([*seg, "{id}", ":name", "{x}"]) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["/users/{id}", "/users/me", "/", None]
    paths = ["/" + "/".join(rng.choice(seg) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?q=1"]) for _ in range(200)] + ["https://h.example/users/me#top", "/users/ME", None, "", "/users/9"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n long, path string")
    got = templates.match_templates(df, spark.createDataFrame([(t,) for t in known], "template string"))
    assert got.columns == ["n", "path", "template"]
    assert {r.n: r.template for r in got.collect()} == {i: best_template(p, [t for t in known if t is not None]) for i, p in enumerate(paths)}
    assert templates.match_templates(df, spark.createDataFrame([], "template string")).where("template is not null").count() == 0
    assert templates.match_templates(df.limit(0), spark.createDataFrame([("/a",)], "template string")).count() == 0


def test_link_tree(spark):
    h = "https://h.example"
    links = [("/", "/a"), ("/", "/b"), ("/a", "/c"), ("/b", "/c"), ("/c", "/"), ("/c", "/d"), ("/d", "/e"), ("/e", "/f"), ("/a", "/login"), ("/login", "/z"), ("/x", "/y"), ("/a", "/a.png"), ("/a", "/a")]
    df = spark.createDataFrame([(h + a, h + b) for a, b in links] * 2 + [(f"{h}/b", "https://other.example/")], "src string, dst string")
    got = {r.url.removeprefix(h): ((r.parent or "").removeprefix(h), r.depth, r.reason) for r in linktree.link_tree(df, spark.createDataFrame([(h + "/",), (h + "/",)], "url string")).collect()}
    assert got == {"/": ("", 0, None), "/a": ("/", 1, None), "/b": ("/", 1, None), "/c": ("/a", 2, None), "/d": ("/c", 3, None), "/e": ("/d", 4, "depth"), "/login": ("/a", 2, "irrelevant"), "/a.png": ("/a", 2, "asset"), "https://other.example/": ("/b", 2, "external")}
    assert linktree.link_tree(df, spark.createDataFrame([], "url string")).count() == 0


def test_page_links(spark):
    pages = spark.createDataFrame([("https://H.example/a/b?x=1#f", '<a href="/c">c</a> <A class="k" href="d">d</A><a href="mailto:x@y">m</a>'), (None, "<a href='/q'>"), ("https://h.example", None)], "url string, html string")
    h = "https://h.example"
    got = {(r.src.removeprefix(h), r.dst.removeprefix(h)) for r in linktree.page_links(pages).collect()}
    assert got == {("/a/b?x=1", "/c"), ("/a/b?x=1", "/a/d"), ("/", "/a"), ("/a", "/a/b?x=1")}


def test_snapshots(spark, tmp_path):
    rng = random.Random(6)
    old = {i: f"h{rng.random()}" for i in range(3000)} | {5000: None}
    new = dict(old)
    for i in rng.sample(range(3000), 7):
        new[i] = "changed"
    del new[11], new[5000]
    new |= {7000: "x", 7001: None}
    frame = lambda d: spark.createDataFrame([(i, h) for i, h in d.items()], "id long, content_hash string")
    a = merkle.Snapshot.take(frame(old), f"{tmp_path}/a", digits=3)
    b = merkle.Snapshot.take(frame(new).repartition(5), f"{tmp_path}/b", digits=3)
    again = merkle.Snapshot.take(frame(old).repartition(7), f"{tmp_path}/c", digits=3)
    assert a.root() == again.root() != b.root() and merkle.changes(a, again)[0].count() == 0
    found, read = merkle.changes(a, b)
    want = {i: "added" if i not in old else "removed" if i not in new else "changed" for i in {*old, *new} if old.get(i, 0) != new.get(i, 0)}
    assert {r.id: r.change for r in found.collect()} == want
    assert read["stripes_read"] <= len(want) < read["stripes"] / 50 and read["folders_read"] <= len(want)


def test_snapshot_edges(spark, tmp_path):
    """Repeated ids count, null ids are ids, an empty table has a root."""
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "c")]
    take = lambda r, n: merkle.Snapshot.take(spark.createDataFrame(r, "id long, content_hash string"), f"{tmp_path}/{n}")
    a, b, none = take(rows, "a"), take(rows[1:], "b"), take([], "none")
    assert {(r.id, r.change) for r in merkle.changes(a, b)[0].collect()} == {(None, "changed")}
    assert {(r.id, r.change) for r in merkle.changes(none, b)[0].collect()} == {(None, "added"), (1, "added")}
    assert {(r.id, r.change) for r in merkle.changes(b, none)[0].collect()} == {(None, "removed"), (1, "removed")}
    assert merkle.changes(none, none)[0].count() == 0
