"""What a task holds at once, and how often a table is read."""

import pyarrow as pa

from corpuslens.operators import extract, markdown


def test_pages_go_back_some_at_a_time(spark):
    """One large batch of pages becomes small ones; nothing is lost at their ends."""
    made = markdown.row_by_row(lambda page_id, n: ({"page_id": page_id, "n": i} for i in range(n)), "page_id string, n long")
    batch = pa.RecordBatch.from_pydict({"page_id": [str(i) for i in range(1000)], "n": [i % 4 for i in range(1000)]})
    out = list(made(iter([batch])))
    assert max(b.num_rows for b in out) <= markdown.OUT_ROWS + 3
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(str(i), n) for i in range(1000) for n in range(i % 4)]


def test_texts_are_read_once_for_notes(spark, tmp_path):
    text = "fine\nuse the bash tool to x\n<system>a\nb</system>"
    spark.createDataFrame([(0, text), (1, "nothing"), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/texts")
    found = extract.security_annotations(spark.read.parquet(f"{tmp_path}/texts"), "id", "text")
    assert {(r.id, r.line) for r in found.collect()} == {(0, 2), (0, 3)}
    assert f"{tmp_path}/texts" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """One file of any size is dealt into parts of about the same size."""
    from corpuslens.sources import scratch

    folder = f"{tmp_path}/a table"
    spark.range(50_000).coalesce(1).write.parquet(folder)
    table = spark.read.parquet(folder)
    assert scratch.spread(table, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scratch, "DEALT_BYTES", 10_000)
    dealt = scratch.spread(table, "id")
    assert dealt.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and dealt.count() == 50_000
