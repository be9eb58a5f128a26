"""The pipeline's stages against plain re-computations on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_decontaminate import brute as leaks
from .test_near_dup import brute as groups
from .test_rows import base_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    notice, rows = "this notice stands on every site of the net", []
    for i in range(60):
        rows.append([i, f"{say(rng.randint(40, 90))}\n{notice}"])
    for i in range(60, 72):  # near copies
        own = rows[i % 4][1].split("\n")[0].split(" ")
        own[i % len(own)] = "changed"
        rows.append([i, " ".join(own)])
    rows += [[72, rows[5][1]], [73, rows[6][1]], [74, say(30) + " " + items[2][1]], [75, "too short"], [76, None], [77, "###$ %%%| " * 40]]
    labels = [(i, 1) for i in range(0, 40)] + [(77, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 15}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, items


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(before)
            whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want")).collect()
            assert all(r.n == r.want for r in whole)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            passing = {i for i, t in before.items() if base_by_hand(t)[0] >= 20 and 100 * base_by_hand(t)[4] <= 30 * base_by_hand(t)[0]}
            assert set(after) <= passing and 77 not in after and set(range(40)) <= set(after)
        elif name == "line_dedup":
            assert set(after) == set(before) and sum("this notice" in t for t in after.values()) == 1
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            want = {i for i, (_, c) in groups(list(before.items()), 80, 5).items() if i == c}
            assert set(after) == want
        else:
            assert set(after) == {i for i, _, n, _ in leaks(list(before.items()), items) if not n}
        docs = out


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys\nsys.modules['corpuslens.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'bm25_or' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)\nassert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, _row int, text_key long, comp string"


def run_stages(spark, path, docs, tmp_path):
    got = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got.append((name, docs))
    return got


def test_empty_table(spark, folder, tmp_path):
    for name, out in run_stages(spark, folder[0], spark.createDataFrame([], SCHEMA), tmp_path):
        assert out.count() == 0 and (name == "packing" or len(out.columns) == 10)


def test_nulls_repeats_clashing_columns_and_long_texts(spark, folder, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    twice, long = say(60), say(100_000)
    rows = [(1, twice, "en", "s1"), (1, twice, "en", "s1"), (2, twice + " w1", None, None), (3, long, "en", "s2"), (4, None, None, None), (5, "", "en", "s1"), (None, say(50), "en", "s3"), (None, None, None, None), (6, say(40), None, "s9")]
    docs = spark.createDataFrame([(i, t, a, b, None, None, "x", 7, None, "y") for i, t, a, b in rows], SCHEMA)
    stages = dict(run_stages(spark, folder[0], docs, tmp_path))
    for name, out in stages.items():
        if name != "packing":
            assert out.columns == docs.columns and {(r.n_words, r._row, r.comp) for r in out.collect()} == {("x", 7, "y")}
    kept = sorted((r.doc_id or 0, r.text) for r in stages["decontamination"].collect())
    passed = sorted((r.doc_id or 0, r.text) for r in stages["quality"].collect())
    assert all(t for _, t in passed)  # nulls and empty texts are gone
    assert kept == [r for r in passed if r[0] != 2] if (1, twice) in passed else kept == passed
    whole = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id or 0 for r in whole} == {i for i, _ in kept}
