"""Manifests, discovery, the store and incremental ingestion."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import discovery, workspace
from corpuslens.sources.store import Store
from corpuslens.streaming import ingest

FILES = {
    "web/package.json": json.dumps({"dependencies": {"next": "^14.2.0"}, "devDependencies": {"jest": "29"}}), "web/package-lock.json": json.dumps({"packages": {"node_modules/next": {"version": "14.2.3"}}}),
    "web/node_modules/x/package.json": json.dumps({"dependencies": {"hidden": "1"}}), "rs/Cargo.toml": '[dependencies]\nserde = { version = "1.0" }\n', "rs/Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.7"\n',
    "go/go.mod": "module m\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n)\n", "py/requirements.txt": "# c\nFlask[async]>=2.0 ; python_version > '3'\n-r x\n", "py/pyproject.toml": '[project]\ndependencies = ["httpx>=0.2"]\n',
    "php/composer.json": json.dumps({"require": {"php": "8", "laravel/framework": "^10"}}), "rb/Gemfile": "gem 'rails', '~> 7.0'\n", "dart/pubspec.yaml": "name: x\ndependencies:\n  http: ^1.0.0\n", "jv/pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency>",
}


def test_manifests(spark, tmp_path):
    for name, text in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {(r.ecosystem, r.name): r.version for r in workspace.dependencies(workspace.read_files(spark, str(tmp_path))).collect()}
    assert rows == {
        ("npm", "next"): "14.2.3", ("npm", "jest"): "29", ("cargo", "serde"): "1.0.7", ("go", "github.com/gin-gonic/gin"): "1.9.1", ("pypi", "flask"): "2.0", ("pypi", "httpx"): "0.2", ("composer", "laravel/framework"): "10",
        ("rubygems", "rails"): "7.0", ("pub", "http"): "1.0.0", ("maven", "g:a"): "3",
    }
    deps = workspace.dependencies(workspace.read_files(spark, str(tmp_path)))
    resolved = spark.createDataFrame([("next", "14.2.3", "v14", "major", 0.9)], "project string, version string, selected string, match_type string, confidence double")
    lock = workspace.lock_document(deps, resolved, None, "t0")
    workspace.write_lock(str(tmp_path / "docs.lock"), lock)
    assert workspace.lock_document(deps, resolved, workspace.read_lock(str(tmp_path / "docs.lock")), "t1")["generated_at"] == "t0"


def test_discovery(spark):
    sites = spark.createDataFrame([("https://x.org/docs",)], "url string")
    assert discovery.candidate_urls(sites).where("type = 'llms_txt'").orderBy("rank").first().url == "https://x.org/llms.txt"
    found = spark.createDataFrame([("http://A", "web", 5), ("http://a", "llms_txt", 0)], "url string, type string, rank int")
    assert [r.type for r in discovery.union_sources(found).collect()] == ["llms_txt"]
    kinds = [("llms_txt", "# T\n- [a](http://a)", True), ("llms_txt", "<html># T", False), ("openapi", '{"openapi": "3.0"}', True), ("openapi", "{bad", False), ("sitemap", "<urlset>", True), ("skill", "---\nname: x\n---\n", True)]
    df = spark.createDataFrame(kinds, "type string, body string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", discovery.valid_source(F.col("type"), F.lit(200), F.col("body"))).collect())
    assert discovery.parse_llms_txt("# T\n## S\n- [a](u): d") == [{"section": "S", "title": "a", "url": "u", "description": "d"}]
    html = spark.createDataFrame([("https://docs.x.org/a", "<title>Guide</title><pre>x</pre><nav class='sidebar'>"), ("https://x.org/", "<p>shop</p>")], "url string, html string")
    assert [r.is_documentation for r in discovery.documentation_score(html).orderBy("url").collect()] == [True, False]
    graph = {"r": ["a", "b"], "a": ["c"], "b": ["a"], "c": ["d"], "d": []}
    fetch = lambda w: w.withColumn("body", F.col("url"))
    links = spark.createDataFrame([(p, u, 0) for p, us in graph.items() for u in us], "parent string, url string, priority int")
    pages = discovery.crawl(spark.createDataFrame([("r",)], "url string"), fetch, lambda p: links.join(p.select(F.col("url").alias("parent")), "parent", "left_semi"), max_depth=2)
    assert {r.url: r.depth for r in pages.collect()} == {"r": 0, "a": 1, "b": 1, "c": 2}
    assert {r.url: r.parent for r in discovery.tree_edges(pages).collect()} == {"r": None, "a": "r", "b": "r", "c": "a"}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_store_upserts_and_snapshots(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), "source_id string, page_id string, url string, content_hash string")
    store.upsert("pages", rows(("s", "p1", "u1", "h1"), ("s", "p2", "u2", "h2")))
    first = store.snapshot("s", "2024-01-01", "v1")
    assert store.snapshot("s", "2024-01-02") == first and store.read("snapshots").first().doc_version == "v1"
    store.upsert("pages", rows(("s", "p1", "u1", "h9")))
    assert {r.page_id: r.content_hash for r in store.read("pages").collect()} == {"p1": "h9", "p2": "h2"}
    assert store.snapshot("s", "2024-01-03") != first and store.latest_snapshots().first().captured_at == "2024-01-03"
    links = spark.createDataFrame([("p1", "x"), ("p2", "y")], "page_id string, url string")
    store.insert_absent("links", links)
    store.insert_absent("links", links)
    assert store.read("links").count() == 2
    store.delete("pages", lambda p: p.where("page_id = 'p1'"))
    assert [r.page_id for r in store.read("links").collect()] == ["p1"]


def test_stream(spark, store, tmp_path):
    raw = f"{tmp_path}/raw"
    html = "<title>T</title><h1>A</h1><p>one</p><h2>B</h2><pre>function foo() {}</pre>"
    one = lambda h, t: spark.createDataFrame([("s", "https://x.org/a?utm_source=1", h, t, "v1")], "source_id string, url string, html string, fetched_at string, doc_version string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    one(html, "2024-01-01").write.parquet(f"{raw}/1")
    for k in (1, 2):
        q = ingest.stream_pages(spark, f"{raw}/*", store, f"{tmp_path}/cp")
        q.awaitTermination()
        if k == 1:
            assert store.read("chunks").count() == 2 and store.read("symbols").where("name = 'foo'").count() == 1
            one("<title>T</title><h1>A</h1><p>two</p>", "2024-01-02").write.parquet(f"{raw}/2")
    assert store.read("pages").count() == 1 and [r.content for r in store.read("chunks").collect()] == ["two"]
    assert {r.doc_version for r in store.read("chunks").collect()} == {"v1"}
    ids = {r.chunk_id for r in store.read("chunks").collect()}  # no orphans of the first version
    assert {r.src for r in store.read("chunk_edges").collect()} <= ids and {r.chunk_id for r in store.read("symbols").collect()} <= ids


def test_store_transactions_and_buckets(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), "source_id string, page_id string, url string, content_hash string")
    store.upsert("pages", rows(*(("s", f"p{i}", f"u{i}", "h") for i in range(40))))
    before = store._state()["tables"]["pages"]
    store.upsert("pages", rows(("s", "p3", "u3", "new")))
    after = store._state()["tables"]["pages"]
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket was written anew
    with pytest.raises(RuntimeError), store.transaction():
        store.upsert("pages", rows(("s", "p4", "u4", "lost")))
        store.insert_absent("links", spark.createDataFrame([("p1", "x")], "page_id string, url string"))
        raise RuntimeError
    assert store.read("links") is None and {r.content_hash for r in store.read("pages").collect()} == {"h", "new"}
    other = Store(spark, store.folder)
    with pytest.raises(Exception, match="exists"), store.transaction():
        store.upsert("pages", rows(("s", "p5", "u5", "mine")))
        other.upsert("pages", rows(("s", "p6", "u6", "theirs")))
    assert {r.content_hash for r in store.read("pages").collect()} == {"h", "new", "theirs"}
    for k in range(4):  # files of old states go
        store.upsert("pages", rows(("s", "p7", "u7", f"k{k}")))
    assert len(store._pointers()) == 2
    store.delete("pages", lambda p: p.where("false"))
    assert store.read("pages").count() == 0
