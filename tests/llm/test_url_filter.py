"""URL rules by hand, and the template tree against a plain recursion over all pages."""

import random
import re
from collections import defaultdict

from corpuslens.llm import url_filter


def rule_by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), a, r) for a, r in url_filter.RULES if (("." + host).endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules(spark):
    urls = [
        "http://a.example.org/en/12?x", "https://EXAMPLE.org/es/1", "http://example.org/es", "http://notexample.org/es/", "http://x.com/fr/a/b#c", "http://x.com/de/", "http://com/de/1", "ftp://org", "http://org/",
        "http://x.org?u=/a", "nourl", "", None, "://", "http://a://b.com/fr/", "http://casino-win.net/en/1", "http://casino-win.net/en/2", "http://good.net/en/3", "http://good.com:80/fr/", "http://É.Com/fr/é",
        "http://good.net/" + "a/" * 5000,
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = rule_by_hand(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), u
        if rule:
            assert got[i].verdict == rule[0]
        else:
            assert got[i].verdict == "allow"  # nothing else is labelled
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def general(segment):
    stem, suffix = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", segment).groups()
    for kind, pattern in (("{n}", r"\d+"), ("{hex}", r"(?=.*\d)[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*"), ("{id}", r".*\d{3,}.*")):
        if re.fullmatch(pattern, stem):
            return kind + (suffix or "")
    return segment


def tree_by_hand(rows):
    """rows: (host, path, bad, good) -> {(host, path): (template, bad, good, purity)}"""
    named = {(h, p): [general(s) for s in p.split("/") if s] for h, p, _, _ in rows}
    depth = max(map(len, named.values()))
    for d in range(depth):
        kids = defaultdict(lambda: [0, 0, 0])
        for h, p, b, g in rows:
            s = named[h, p]
            if len(s) > d:
                for k, x in enumerate((1, b, g)):
                    kids[h, tuple(s[:d]), s[d]][k] += x
        nodes = defaultdict(list)
        for (h, prefix, child), v in kids.items():
            nodes[h, prefix].append((child, *v))
        wild = set()
        for (h, prefix), own in nodes.items():
            total, bad, good = (sum(c[i] for c in own) for i in (1, 2, 3))
            for child, _, b, g in own:
                if len(own) < 2:
                    continue
                seen, rate = b + g, (bad + 0.5) / (bad + good + 1)
                others = bad + good - seen
                gap = abs((b + 0.5) / (seen + 1) - (bad - b + 0.5) / (others + 1))
                if (len(own) >= 8 and len(own) >= 0.5 * total) or gap <= 1.96 * (rate * (1 - rate) * (1 / (seen + 1) + 1 / (others + 1))) ** 0.5:
                    wild.add((h, prefix, child))
        for key, s in named.items():
            if len(s) > d and (key[0], tuple(s[:d]), s[d]) in wild:
                named[key] = [*s[:d], "*", *s[d + 1 :]]
    whole, hosts, branches = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, p, b, g in rows:
        for v in (whole, hosts[h], branches[h, tuple(named[h, p])]):
            v[0] += b
            v[1] += g
    smooth = lambda v, toward: (v[0] + 5 * toward) / (sum(v) + 5)
    prior = whole[0] / max(1, sum(whole))
    return {(h, p): ("/" + "/".join(s), *branches[h, tuple(s)], smooth(branches[h, tuple(s)], smooth(hosts[h], prior))) for (h, p), s in named.items()}


def test_tree_equals_a_recursion_over_pages(spark):
    rng = random.Random(4)
    pages, labelled = [], []
    for i in range(900):
        host = rng.choice(["a.net", "b.net", "www.c.com", "d.org", "plain.net"])
        section = rng.choice(["news", "shop", "fr", "de", "u"])
        rest = {"news": f"{rng.randint(2000, 2020)}/{rng.randint(1, 9)}/t{i}", "shop": rng.choice(["x", "y"]) + f"/{i}.html", "u": f"user{i}/about"}.get(section, str(i))
        pages.append((i, f"http://{host}/{section}/{rest}"))
        if host != "plain.net" and rng.random() < 0.5:
            labelled.append((i, int(rng.random() < (0.9 if (host, section) == ("a.net", "shop") else 0.1))))
    labelled.append((5, None))
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "page_id long, bad int")).collect()}
    bad, rows = dict(labelled[:-1]), []
    for i, u in pages:
        host, path, rule = rule_by_hand(u)
        label = {"block": 1, "allow": 0}[rule[0]] if rule else bad.get(i)
        rows.append((host, path, int(label == 1), int(label == 0)))
    want = tree_by_hand(rows)
    verdicts = defaultdict(set)
    for (i, u), (host, path, _, _) in zip(pages, rows):
        template, b, g, purity = want[host, path]
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9, u
        rule = rule_by_hand(u)[2]
        assert got[i].verdict == (rule[0] if rule else "block" if b + g and purity >= 0.5 else "allow"), u
        verdicts[host].add(got[i].verdict)
    assert verdicts["a.net"] == {"block", "allow"}  # no bad word in the host, and its templates differ
    assert verdicts["plain.net"] == {"allow"}  # no labels


def test_block_rules_are_labels(spark):
    rows = [(i, f"http://one.net/bad/{i}") for i in range(30)] + [(100 + i, f"http://one.net/fine/{i}") for i in range(30)]
    rules = (*url_filter.RULES, ("block", "one.net/bad/1"), ("allow", "one.net/fine/1"))
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(got[i] == "block" and got[100 + i] == "allow" for i in range(30))


def test_many_children_become_a_wildcard(spark):
    rows = [("h", f"blog/post{chr(97 + i)}x", 0, 1) for i in range(20)] + [("h", "shop/a", 1, 0)] * 20 + [("h", "blog/fix", 0, 1)]
    found = {r.raw: r for r in url_filter.template_tree(spark.createDataFrame(rows, "host string, raw string, bad long, good long")).collect()}
    assert found["blog/postax"].template == "/blog/*" and found["shop/a"].template == "/shop/a"
    assert found["shop/a"].purity > 0.7 > 0.3 > found["blog/fix"].purity


def test_labels_by_text(spark):
    docs = spark.createDataFrame([(1, "A good\ntext, here."), (2, "Spam spam"), (3, None), (4, "  \n"), (5, "spam SPAM!"), (6, "unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, 1, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "Title\nA good text here"), (2, "spam spam"), (3, ""), (4, None), (5, "unlabelled"), (1, "Title\nA good text here")], "page_id long, text string")
    got = sorted(map(tuple, url_filter.labels_by_text(pages, docs, labels).collect()))
    assert got == [(1, 0), (2, 0), (2, 1)]
