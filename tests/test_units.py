"""Units found by one walk over a document's terms, against a plain look at every place."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import index
from corpuslens.operators.units import Units


def plain(docs, keys):
    found = {}
    for d, terms in enumerate(docs):
        for u, (unit, prefix) in enumerate(keys):
            for i in range(len(terms) - len(unit) + 1):
                own = terms[i : i + len(unit)]
                if own == list(unit) or prefix and own[:-1] == list(unit[:-1]) and own[-1].startswith(unit[-1]):
                    found[d, u] = found.get((d, u), 0) + 1
    return sorted((*k, n) for k, n in found.items())


def test_walk(monkeypatch):
    """Overlaps, phrases that begin alike, one within another, beginnings after a phrase; documents in several pieces."""
    import pyarrow as pa

    from corpuslens.operators import units

    monkeypatch.setattr(units, "WALKED", 50)
    rng = random.Random(1)
    docs = [[rng.choice(["a", "b", "ab", "abc", "é", "éa"]) for _ in range(rng.choice([0, 1, 5, 30]))] + [""] for _ in range(60)]
    keys = [(("a",), False), (("a",), True), (("ab",), True), (("a", "a"), False), (("a", "a", "b"), False), (("a", "b"), False), (("a", "b", "a"), True), (("b", "é"), True), (("nowhere", "a"), False), (("b", "b", "b", "b"), False)]
    assert list(zip(*(x.tolist() for x in Units(keys).counted(pa.array(docs))), strict=True)) == plain(docs, keys)


def frame(spark, docs):
    return index.index_terms(spark.createDataFrame(docs, "id long, body string"), "id", ["body"])


def units_of(spark, tokens, prefix=None):
    return index.query_units(spark.createDataFrame(list(enumerate(tokens)), "query_id long, tokens array<string>"), F.col("tokens"), prefix)


def test_phrases_are_counted_in_their_row(spark):
    """A phrase of common words: documents are not repeated for it, joined or shuffled."""
    found = index.unit_counts(frame(spark, [(i, "the end of the " + ("road" if i % 5 else "of the road")) for i in range(40)]), units_of(spark, [["of-the", "of-the-road"]]))
    assert sorted((r.unit, r.id, r.tf) for r in found.collect()) == sorted([(0, i, 1 if i % 5 else 2) for i in range(40)] + [(1, i, 1) for i in range(40)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_beginnings_are_counted_in_their_row(spark):
    found = index.unit_counts(frame(spark, [(i, "road roads roadside other") for i in range(40)]), units_of(spark, [["road"], ["roadside"]], 4))
    assert sorted((r.query_id, r.id, r.tf) for r in found.collect()) == sorted([(0, i, 3) for i in range(40)] + [(1, i, 1) for i in range(40)])
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_keep_the_best_only(spark):
    """Equal scores are cut by id in the tasks already; the ranking is that of all scores."""
    idx, units = frame(spark, [(i, "a b" if i % 3 else "a c c c") for i in range(400)]), units_of(spark, [["a"], ["a", "c"]])
    ranked = lambda df: sorted((r.query_id, r.position, r.id, r.score) for r in index.top_k(df.withColumn("score", F.round("score", 6)), 5).collect())
    few = index.bm25(idx, units, 5)
    assert ranked(few) == ranked(index.bm25(idx, units)) and few.count() <= 2 * 2 * 5 * few.rdd.getNumPartitions()
