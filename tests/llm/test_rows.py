"""HTML text, token counts, URL rules, line removal and quality rules."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import html_text, line_dedup, quality, token_count

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve your stay on this site, really.</div><div class="ad">Buy this very good thing now.</div>
%s<aside class="sidebar"><p>Popular posts of the week, picked for you by our editors.</p></aside>
<form><label>Mail</label><input name="m"><button>Send</button></form>
<div id="comments"><h3>Comments</h3><p>First! I have read it all and I liked it a lot, thank you.</p></div><footer>&copy; Someone</footer></body></html>"""
BODY = """<h1>A   title &amp; more</h1><p><b>First paragraph
 with bold text.<br>And a line.<p>Second &lt;one&gt; &eacute;&#233; is long enough to count as text, one would say.</p><ul><li>x<li>y</ul><p>Ti.</p>"""
WANT = "A title & more\nFirst paragraph with bold text. And a line.\nSecond <one> éé is long enough to count as text, one would say.\nx\ny\nTi."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="wrap"><div class="post-content">%s</div></div>', "<div><div><div>%s</div></div></div>", '<section role="main">%s</section>'])
def test_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == WANT


def speechless(k, rng):
    """A page whose containers say nothing, and its article."""
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "eps"]) for _ in range(n))
    menu = "".join(f"<div><a href='/{i}'>{say(2)}</a></div>" for i in range(rng.randint(3, 9)))
    lines = [f"Heading {k}"] + [say(rng.choice([2, 3, 60, 80, 120])) for _ in range(rng.randint(4, 9))] + [say(90)]
    article = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x[:40]}<b>{x[40:]}</b></p>" for x in lines[1:])
    html = f"<html><body><div><div>{menu}</div><div>{article}</div><div><div>{say(6)}</div><div><a href='/x'>{say(3)}</a> {say(2)}</div></div></div></body></html>"
    return html, "\n".join(" ".join(x.split()) for x in lines)


def test_ratios_decide_where_containers_say_nothing(monkeypatch):
    """The smoothed ratio and its threshold find the article; without them the answer is another."""
    rng = random.Random(11)
    pages = [speechless(k, rng) for k in range(60)]
    assert [html_text.main_text(h) for h, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text, "content_region", lambda reader: set(range(len(reader.parents))))
    assert not any(html_text.main_text(h) == t for h, t in pages)


def test_main_text_edges(spark):
    assert html_text.main_text("just text &amp; no tags") == "just text & no tags"
    assert html_text.main_text("<p>a<p>b") == "a\nb"
    assert html_text.main_text("<article><header class='x'><h1>H</h1></header><p>t</p><footer>f</footer><article class='comment'>c</article></article>") == "H\nt"
    assert html_text.main_text("<nav>menu</nav>") == ""
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999
    rows = [(1, "u", None, 7), (2, None, "", 7), (3, "u", "<p>é</p>", 7), (3, "u", "<p>é</p>", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(tuple(r) for r in html_text.extract_main_text(df).collect() if r.url)
    assert got == [(1, "u", "", 0), (3, "u", "é", 1), (3, "u", "é", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_counts_equal_the_library(spark):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = token_count.vocabulary(token_count.model_path())
    least = min(s for _, s in pieces)  # byte pieces get it too, so that the library's least score is the same
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", least) for b in range(256)] + pieces
    lib = Tokenizer(models.Unigram(vocab, 0, True))
    lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[ \\t\\n\\x0b\\x0c\\r]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    rng = random.Random(1)
    texts = ["Hello world, this is it", "", None, "  \n", "日本語 テスト 𝄞𝄞 x", "aaaaaaaaaaaaaaaaaaaa", "a\u00a0b", "ééé ñandú Übergröße", "x" * 3000]
    texts += ["".join(rng.choice("abcdefghéñ tionghr 日") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    counter = token_count.UnigramCounter(pieces)
    counts, _ = counter.texts(pa.array(texts))
    assert counts.tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    assert [r.n_tokens for r in token_count.count_tokens(df).orderBy("doc_id").collect()] == counts.tolist()
    assert token_count.count_tokens(df.limit(0)).count() == 0


def test_ties_keep_the_earliest_start():
    counter = token_count.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)])
    assert counter.best("▁ab") == (1, -3.0)
    assert counter.best("▁aab") == (2, -4.0)


def test_line_removal(spark):
    common, rare, text = "common line of all sites", "rare line", "own {} words"
    rows = [(i, f"{common}\n{text.format(i)}\n\n{rare if i < 5 else 'else'}{i if i >= 5 else ''}", f"s{i}", 3) for i in range(14)]
    rows += [(100 + i, "a whole copy\nwith two lines", f"s{i}", 3) for i in range(14)]
    rows += [(200, None, "s1", 3), (201, "", None, 3), (202, common, None, 3), (None, common + "\nx", "s2", 3), (5, common + "\nrepeated id", "s5", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    got = {(r._row.doc_id, r._row.text): r for r in line_dedup.remove_boilerplate(df).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for i, t, s, _ in rows:
        r = got[i, t]
        cut = t is not None and i is not None and i != 0 and common in t
        want = t if not cut else "\n".join(x for x in t.split("\n") if x != common)
        assert r.text == want and r.n_removed == int(cut)
    assert [r.doc_id for r in line_dedup.dedup_lines(df).where("doc_id = 3").collect()] == [3]
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def base_by_hand(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if many[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark):
    rng = random.Random(2)
    good, bad = ["the", "of", "and", "tree", "house", "é𝄞"], ["$$x", "#y", "***", "z|z"]
    say = lambda w, n: "".join(rng.choice(w) + rng.choice([" ", " ", "\n", "\t\x0b"]) for _ in range(n))
    rows = [(i, say(bad if i % 4 == 0 else good, rng.randint(25, 300))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n\n "), (103, "a b c"), (104, "x y z w q r t u " * 30), (105, "same line here\n" * 30), (106, "a\u00a0b " * 25), (107, "one two three four five six seven eight nine one two three four five six seven eight")]
    docs = spark.createDataFrame([(i, t, False) for i, t in rows], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(60)] + [(None, 1), (500, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    for i, t in rows:
        n, chars, symbols, dup, rep = base_by_hand(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), i
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
        if i < 80 and not r.base_failed:
            assert r.kept == (i % 4 != 0), i
    kept = quality.keep_quality(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept) and kept.columns == docs.columns
    none = quality.judge_quality(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


def test_quality_ids_of_any_type_and_long_texts(spark):
    rng = random.Random(3)
    say = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    rows = [(f"d{i}", say(["the", "of", "tree"], 30) if i % 2 else say(["$$", "#y", "z|"], 30), i) for i in range(40)]
    rows += [("long", say(["the", "of", "tree", "house"] + [f"t{k}" for k in range(5000)], 50_000), 0), ("d1", rows[1][1], 1), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_words int")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)] + [("d1", 1)], "doc_id string, quality int")
    got = quality.judge_quality(docs, labels).collect()
    assert len(got) == len(rows) and {r.n_words for r in got if r.doc_id == "long"} == {50_000}
    assert len({r.kept for r in got if r.doc_id == "d1"}) == 1


def test_ratio_and_threshold_by_hand(spark):
    """Integer ratios, scores and the cut against a plain re-computation from the same hashes."""
    import math

    rng = random.Random(5)
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(good if rng.random() < (0.8 if i % 3 else 0.2) else bad) for _ in range(rng.randint(25, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")
    hashed = quality.with_words(docs, "text").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2))).collect()
    cells, n = {r.doc_id: [h % 64 for h in [*r._h, *r._h2]] for r in hashed}, 64
    raw, target = Counter(), Counter()
    for r in hashed:
        raw.update(cells[r.doc_id])
        if r.doc_id < 50 and r.doc_id % 3 and r.fold == 0:
            target.update(cells[r.doc_id])
    log = lambda c, x: math.log((c[x] + 1) / (sum(c.values()) + n))
    ratio = {x: round(quality.SCALE * (log(target, x) - log(raw, x))) if raw[x] else 0 for x in range(n)}
    score = {i: sum(ratio[x] for x in c) // len(c) for i, c in cells.items()}
    failed = {r.doc_id: r.base_failed for r in quality.judge_quality(docs, labels, buckets=n).collect()}
    judged = [(score[r.doc_id], int(r.doc_id % 3 > 0)) for r in hashed if r.doc_id < 50 and not failed[r.doc_id] and (r.doc_id % 3 == 0 or r.fold == 1)]
    values = sorted({v for v, _ in judged})
    gain = lambda v: sum(k for s, k in judged if s >= v) / max(1, sum(k for _, k in judged)) + sum(1 - k for s, k in judged if s < v) / sum(1 - k for _, k in judged)
    best = max(values, key=lambda v: (gain(v), -v))
    cut = (best + values[values.index(best) - 1]) // 2 if best != values[0] else best
    for r in quality.judge_quality(docs, labels, buckets=n).collect():
        total = sum(ratio[x] for x in cells[r.doc_id])
        assert r.kept == (not r.base_failed and total >= cut * len(cells[r.doc_id])), r.doc_id


def test_lines_without_an_id_and_very_long_ones(spark):
    common, long = "shared by all", "x " * 100_000
    rows = [(i, f"{common}\n{long}{i}", f"s{i}") for i in range(12)] + [(None, f"{common}\nown {i}", f"s{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r._row.doc_id, r.text) for r in line_dedup.remove_boilerplate(df).collect()]
    assert sorted(t for i, t in got if i is None) == sorted(t for i, t, _ in rows if i is None)
    assert {i: t for i, t in got if i is not None} == {i: t if i == 0 else f"{long}{i}" for i, t, _ in rows if i is not None}
