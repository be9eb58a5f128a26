"""Column functions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions import urls as U


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTPS://Docs.Example.COM/a//b/?utm_source=x&b=2&a=1#top", "https://docs.example.com/a/b?a=1&b=2"), ("http://x.org", "http://x.org/"), ("http://x.org:80/a/", "http://x.org/a"),
    ("  local://thing  ", "local://thing"), ("not a url", "not a url"), ("", ""), ("https://x.org/?gclid=1&REF=2", "https://x.org/"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, U.canonical_url, raw) == want


@pytest.mark.parametrize(("href", "want"), [("/a/", "https://x.org/a"), ("b?ref=1&k=2", "https://x.org/docs/b?k=2"), ("//y.org/c", "https://y.org/c"), ("#top", None), ("mailto:a@b", None), ("https://z.org/d#e", "https://z.org/d")])
def test_resolved_link(spark, href, want):
    assert one(spark, U.resolved_link, href, "https://x.org/docs/page") == want


def test_hash_ignores_line_ends(spark):
    assert one(spark, T.content_hash, "a  \r\nb\r\n\r\n") == one(spark, T.content_hash, "a\nb") != one(spark, T.content_hash, "a b")


@pytest.mark.parametrize(("query", "want"), [("How to fix error 404", "troubleshooting"), ("show an example of X", "examples"), ("REST endpoint list", "api"), ("create a webhook", "implementation"), ("zebra", "conceptual")])
def test_intent(spark, query, want):
    assert one(spark, T.intent, query) == want


def test_tokens(spark):
    assert one(spark, T.search_tokens, "How to use the webhook_endpoints API, ok?") == ["use", "webhook_endpoints", "API"]
    assert one(spark, T.search_tokens, "is it on") == ["is", "it", "on"]
    assert one(spark, T.terms, "Café webhook_endpoints x-y") == ["cafe", "webhook", "endpoints", "x", "y"]
    assert one(spark, lambda c: T.leading_method(c)[0], "post /v1/x") == "POST"
    assert one(spark, T.token_estimate, "abcde") == 2 and one(spark, T.token_estimate, None) == 0


@pytest.mark.parametrize(("url", "title", "content", "want"), [
    ("https://x/releases", "t", "", "release_notes"), ("https://x/a", "FAQ", "", "faq"), ("https://x/a", "Webhooks", "", "webhook"), ("https://x/a", "Create user", "POST /v1/users", "endpoint"), ("https://x/a", "b", "GET /a then GET /b", "api_reference"),
    ("https://x/guides/z", "q", "", "guide"), ("https://x/docs", "q", "", "documentation_overview"), ("https://x/q", "q", "", "other_documentation"),
])
def test_page_type(spark, url, title, content, want):
    assert one(spark, lambda u, t, c: T.page_type(u, t, c, F.lit(2)), url, title, content) == want
