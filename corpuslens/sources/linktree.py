"""The tree of a site's addresses by breadth-first waves over its links.

Each wave joins the addresses found last with the links that leave them and keeps what was
not seen before; the seen ones are a table. A wave is written before the next, so lineage
stays short and a lost executor costs a re-read. An address has the depth of the first wave
that reaches it and, of the addresses one wave before that link to it, the least as parent.
Addresses that a crawler leaves out are in the tree with the reason and are not followed.

Defined cases: links of addresses that no wave reaches are ignored; a link to itself and
cycles end at the seen table; repeated links and roots count once; without roots the tree
is empty. A site is a root, and trees of several sites grow in the same waves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolved_link, skip_reason
from .scratch import written

ORIGIN = r"^([A-Za-z]+://[^/?#]+)"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) of the pages' links, both resolved; each folder of a page's path links to what lies in it."""
    own = resolved_link(F.col(url_col), F.col(url_col))
    page = pages.select(own.alias("src"), html_col).where("src is not null")
    hrefs = page.select("src", F.explode(F.regexp_extract_all(html_col, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    links = hrefs.select("src", resolved_link(F.col("href"), F.col("src")).alias("dst"))
    # https://h/a/b lies in https://h/a, which lies in https://h/
    plain = F.regexp_replace("src", r"[?#].*$", "")
    steps = F.split(F.regexp_replace(plain, ORIGIN + "/?", ""), "/")
    origin = F.regexp_extract("src", ORIGIN, 1)
    above = page.select("src", origin.alias("origin"), F.filter(steps, lambda s: s != "").alias("steps")).distinct()
    at = lambda n: F.when(n == 0, F.concat("origin", F.lit("/"))).otherwise(F.concat_ws("/", "origin", F.array_join(F.slice("steps", F.lit(1), n), "/")))
    inner = above.select("src", "origin", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("n")).where("size(steps) > 0 and n > 0")
    folders = inner.select(at(F.col("n") - 1).alias("src"), F.when(F.col("n") == F.size("steps"), F.col("src")).otherwise(at(F.col("n"))).alias("dst"))
    return links.unionByName(folders).where("dst is not null and src <> dst").distinct()


def link_tree(links: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """links (src, dst), roots (url) -> (root, url, parent, depth, reason); reason is null where the address is followed."""
    links = written(links.select("src", "dst").distinct(), "links")
    wave = roots.select("url").distinct().select(F.col("url").alias("root"), "url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("reason"))
    waves = [written(wave, "wave")]
    for depth in range(1, max_depth + 2):  # one more wave than is followed: it says what the limit leaves out
        seen = reduce(DataFrame.unionByName, [w.select("root", "url") for w in waves])
        reached = waves[-1].where("reason is null").select("root", F.col("url").alias("src")).join(links, "src")
        new = reached.groupBy("root", F.col("dst").alias("url")).agg(F.min("src").alias("parent")).join(seen, ["root", "url"], "left_anti")
        new = new.select("root", "url", "parent", F.lit(depth).alias("depth"), skip_reason(F.col("url"), F.col("root"), F.lit(depth), max_depth).alias("reason"))
        waves.append(written(new, "wave"))
        if waves[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, waves)
