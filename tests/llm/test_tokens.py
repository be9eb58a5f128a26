"""Packing and the binary token format against whole-text encoding."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import packing, rans, wordtok

TEXTS = [
    (3, "Hello, the World. " * 900), (1, None), (2, ""), (7, "a"), (7, "a"), (5, "<|startoftext|> x <|ENDOFTEXT|>"), (6, "x" * 5000),
    (8, "İstanbul ΣΑΣ ǅ é ﬁ don't"), (9, " \n\t "), (4, "a\x01b \x01 c \x1c d"), (11, "日本語 テスト " * 50), (10, "one two three " * 700),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0) for i, t in TEXTS], "doc_id long, text string, ids string, start int").repartition(2)


@pytest.fixture(scope="module")
def truth():
    tok = wordtok.chunk_tokenizer(wordtok.tokenizer_path()).full
    return [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in TEXTS]


def test_chunks_equal_whole_texts(truth):
    tok = wordtok.chunk_tokenizer(wordtok.tokenizer_path())
    for _ in range(2):  # the second time from the memo
        ids, bounds = tok.encode(pa.array([t for _, t in TEXTS]), 1)
        for i, (_, own) in enumerate(truth):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == own.tolist()


def test_segment_round_trip_and_checkpoints():
    rng = np.random.default_rng(5)
    for n in (1, 7, 1000, 5003):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
        data = rans.encode_segment(ids, lanes=8, block_tokens=1000, every=16)
        assert (rans.decode_segment(data) == ids).all()
        if n > 3000:
            assert (rans.decode_segment(data, [2]) == ids[2000:3000]).all()
    symbols, f32 = rans.frequencies(ids)
    f, c = rans._tables(f32)
    assert f32.sum() == 1 << rans.SLOT_BITS and f32.min() >= 1
    block = rans.encode_block(np.searchsorted(symbols, ids), f, c, 8, 16)
    slot = np.repeat(np.arange(len(symbols), dtype=np.uint32), f32)
    for k in (0, 1, 3):
        assert (rans.decode_block(block, symbols, f, c, slot, k) == ids[k * 16 * 8 :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), symbols, f, c, slot)


def test_files_hold_all_ids_in_order(docs, truth):
    got = rans.round_trip(docs, segment_tokens=3000, partitions=3).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in TEXTS)
    at, want = 0, defaultdict(list)
    for i, ids in truth:
        want[i].append(ids.tobytes())
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in want[r.doc_id]
        at += r.n_tokens


def test_pack_every_id_once(docs, truth):
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, ids in truth:
        want[i].append(ids.tobytes())
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            pieces.sort(key=lambda r: r.start)
            assert b"".join(bytes(p.ids) for p in pieces) == want[i][0]
            assert all(p.doc_tokens * 4 == len(want[i][0]) for p in pieces)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in truth)
    groups = defaultdict(int)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at == pieces[0].tier <= 2048 and at & (at - 1) == 0
        groups[pieces[0].step_group] += at
    assert max(groups.values()) <= packing.STEP_TOKENS


def test_crc_matches(docs, truth, spark):
    from pyspark.sql import functions as F

    got = {r.doc_id: r.c for r in rans.round_trip(docs).select("doc_id", F.crc32("ids").alias("c")).collect()}
    assert all(got[i] == zlib.crc32(ids.tobytes()) for i, ids in truth)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).count() == 0
    assert rans.round_trip(none).count() == 0


def test_ranges_and_single_documents(spark):
    """Parts of a segment from its checkpoints, and documents looked up in written segments."""
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 9_000).clip(0, 900).astype(np.uint32)
    data = rans.encode_segment(ids, lanes=8, block_tokens=2_000, every=16)
    for start, length in ((0, 9_000), (0, 1), (1_999, 2), (2_500, 130), (3_999, 2_002), (8_990, 50), (9_000, 5), (40, 0)):
        assert rans.decode_range(data, start, length).tolist() == ids[start : start + length].tolist()
    words = ["alpha", "beta!", "gamma", "x9"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)] + [(7, "again seven"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    segments = rans.encode_corpus(docs, partitions=3, segment_tokens=200)
    segments.cache()
    whole = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in rans.decode_corpus(segments).collect() if r.doc_id in (3, 7, 59))
    wanted = spark.createDataFrame([(3,), (7,), (59,), (7,), (None,), (1000,)], "doc_id long")
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in rans.read_documents(segments, wanted).collect()) == whole
    assert len(whole) == 4 and rans.read_documents(segments, wanted.limit(0)).count() == 0
    segments.unpersist()


def test_read_from_a_segment_of_many(spark):
    """Ten of 20,000 documents of one segment, with null ids among them; no row of the plan carries all lengths to every document."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 1000 != 5, F.col("id")).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text")).coalesce(1)
    segments = rans.encode_corpus(docs, partitions=1)
    segments.cache()
    wanted = spark.range(0, 20_000, 2_000).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: bytes(r.ids) for r in rans.read_documents(segments, wanted).collect()}
    want = {r.doc_id: bytes(r.ids) for r in rans.decode_corpus(segments).join(wanted, "doc_id").collect()}
    assert len(want) == 10 and got == want
    segments.unpersist()
