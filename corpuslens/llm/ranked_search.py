"""Ranked search of a stated set of queries over all documents, by sort-based accumulation.

A document's impact for a term is an integer that falls with the document's length and
rises with the term's frequency; a query's score is the sum over its terms, repeats
included. The k best documents of each query are returned, equal scores by smaller id.

1. Texts are cut into terms once, an Arrow batch at a time. What is kept of a document is
   its length and, for the terms that the queries hold, numbers and frequencies (a few
   per cent of the text), written to the shared folder: all statistics are counted there.
2. Within a task, item, document and impact of all matches of a chunk are concatenated
   arrays. Packed (item, document) keys are sorted by radix, and reduceat sums runs of a
   key. As a document's terms stand in one row, no sum crosses tasks, and what a chunk
   holds is bounded by CHUNK matches, however long or common.
3. A heap keeps the k best of each query in a task; these few rows are dealt in ranges of
   queries and ranked. A task's output has at most k rows for each query.

Queries are taken in blocks whose terms take BLOCK_BYTES at most, so what is broadcast is
bounded for any number of queries; each block is one pass over the documents.

Defined cases: a null text has no terms, and a document without terms is no document of
the collection. Rows are documents: repeated ids are ranked each for itself. Exact repeats
of a query count once; rows that share an id and differ in text are one query with the
terms of all of them. A null id of a document comes after all others, a null id of a query
is an id like others. A query without terms, or whose terms no document holds, has no
rows. An empty table on either side gives an empty result. Ids may be of any type that can
be ordered; other columns are not read. Integers are of 64 bits: 75 times the length of a
document times the number of documents must stay below 2^63.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, built, shared_value, stored, whitespace_words

#: Bytes of the terms of queries that are broadcast at once, and matches (16 bytes and their working copies) summed at once.
BLOCK_BYTES, CHUNK = 16_000_000, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as terms hold them: capitals of ASCII small, everything of ASCII but letters and digits a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def text_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of each text: text i has distinct[codes[offsets[i]:offsets[i+1]]]."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_TABLE))
    return whitespace_words(pa.LargeStringArray.from_buffers(len(texts), offsets, plain), lower=False)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of every query."""
    rows = queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    each = rows.select("item", F.explode(F.split(F.translate("text", UPPER, LOWER), BREAK)).alias("term")).where("term != ''")
    return each.groupBy("item", "term").agg(F.count("*").alias("times"))


def query_blocks(terms: DataFrame) -> list[DataFrame]:
    """The queries in blocks of at most BLOCK_BYTES, unless one query alone is larger."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n)).alias("block")
        sizes = terms.groupBy(block).agg(F.sum(F.octet_length("term") + 24).alias("bytes"), F.count_distinct("item").alias("items"), F.count_if(F.col("item").isNull()).alias("none")).collect()  # n rows at most
        if all(r.bytes <= BLOCK_BYTES or r["items"] + (r.none > 0) == 1 for r in sizes):
            return [terms.where(block == F.lit(r.block)) for r in sizes]
        n *= 2


def _vocabulary(terms: list[str]) -> pa.Array:
    return pa.array(terms, pa.large_string())


def match_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """docs (id, text) -> (id, n, terms, tfs): numbers and frequencies of the terms of the vocabulary in every document with terms."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared, size = shared_value(spark, vocabulary), len(vocabulary)
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(shared, _vocabulary)
        for batch in batches:
            codes, distinct, offsets = text_terms(batch.column("text"))
            n = np.diff(offsets)
            number = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy().astype(np.int64)[codes]
            doc = np.repeat(np.arange(len(n)), n)
            keys, tf = np.unique((doc * size + number)[number >= 0], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(keys // size, minlength=len(n)))))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (keys % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(match, schema)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys of so many bits, by digits of 16 bits from the lowest; numpy counts such digits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class _Queries:
    """What a worker knows of a block: for each term its weight, queries and repeats there."""

    def __init__(self, value: tuple):
        self.items, term, item, times, self.weight, self.n_docs, self.n_terms = value
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.count = np.bincount(term, minlength=len(self.weight))
        self.start = np.concatenate(([0], np.cumsum(self.count)))[:-1]


def _sums(q: _Queries, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of matches (doc, term, impact), whose docs count from 0."""
    count = q.count[term]
    match = np.repeat(np.arange(len(term)), count)
    place = np.arange(len(match)) - np.repeat(np.cumsum(count) - count, count) + q.start[term][match]
    bits = max(1, int(doc[-1]).bit_length())
    keys = q.item[place].astype(np.int64) << bits | doc[match]
    order = radix_order(keys, bits + len(q.items).bit_length())
    keys, values = keys[order], (impact[match] * q.times[place])[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    runs = keys[heads]
    return runs >> bits, runs & (1 << bits) - 1, np.add.reduceat(values, heads)


def score_matches(matched: DataFrame, queries: DataFrame, k: int, value: tuple) -> DataFrame:
    """matched (id, n, terms, tfs) -> (item, id, score): the k best of each query in each task."""
    shared, kind = shared_value(matched.sparkSession, value), matched.schema["id"]
    schema = T.StructType([queries.schema["item"], kind, T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = built(shared, _Queries)
        best: list[list] = [[] for _ in q.items]
        least = np.ones(len(q.items), np.int64)  # what a score must reach
        id_type = item_type = None
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            id_type = ids.type
            rank = pc.rank(ids, null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
            per = pc.list_value_length(terms).to_numpy()
            doc, term, tf = np.repeat(np.arange(len(n)), per), pc.list_flatten(terms).to_numpy(), pc.list_flatten(tfs).to_numpy().astype(np.int64)
            worth = q.weight[term] > 0
            doc, term, tf = doc[worth], term[worth], tf[worth]
            if not len(doc):
                continue
            m = 100 - 75 + 75 * n.to_numpy() * q.n_docs // q.n_terms
            impact = q.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            ends = np.cumsum(np.bincount(doc, q.count[term], len(n)).astype(np.int64))
            at = 0
            while at < len(n):  # as many documents as CHUNK holds, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                a, b = np.searchsorted(doc, [at, to])
                if a < b:
                    item, d, total = _sums(q, doc[a:b] - at, term[a:b], impact[a:b])
                    good = total >= least[item]
                    item, d, total = item[good], d[good] + at, total[good]
                    order = np.lexsort((rank[d], -total, item))
                    item, d, total = item[order], d[order], total[order]
                    place = np.arange(len(item)) - np.searchsorted(item, item)
                    item, d, total = (x[place < k] for x in (item, d, total))
                    for i, s, x in zip(item.tolist(), total.tolist(), ids.take(pa.array(d)).to_pylist(), strict=True):
                        best[i].append((-s, x is None, 0 if x is None else x))
                    for i in np.unique(item).tolist():
                        best[i] = heapq.nsmallest(k, best[i])
                        if len(best[i]) == k:
                            least[i] = -best[i][-1][0]
                at = to
        rows = [(q.items[i], None if none else x, -s) for i, own in enumerate(best) for s, none, x in own]
        if rows:
            items, found, scores = zip(*rows, strict=True)
            item_type = pa.array(q.items).type if any(x is not None for x in q.items) else pa.null()
            yield pa.RecordBatch.from_arrays([pa.array(items, item_type), pa.array(found, id_type), pa.array(scores, pa.int64())], ["item", "id", "score"])

    return matched.mapInArrow(score, schema)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the k best documents of each query whose score is above 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = stored(query_terms(queries, query_col, query_text), "query_terms")
    tops = rows.limit(0).select(F.lit(None).cast(terms.schema["item"].dataType).alias("item"), "id", F.lit(0).cast("long").alias("score"))
    for block in query_blocks(terms):
        own = block.collect()  # BLOCK_BYTES at most
        vocabulary, items = sorted({r.term for r in own}), list(dict.fromkeys(r["item"] for r in own))
        of_term, of_item = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(items)}
        matched = stored(match_terms(rows, vocabulary), "matched")
        n_docs, n_terms = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        value = (items, np.array([of_term[r.term] for r in own]), np.array([of_item[r["item"]] for r in own]), np.array([r.times for r in own]), weight, n_docs, n_terms)
        tops = tops.unionByName(stored(score_matches(matched, terms, k, value), "tops"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    dealt = tops.repartitionByRange(F.col("item"))
    return dealt.select("item", F.row_number().over(order).alias("rank"), "id", "score").where(F.col("rank") <= k)
