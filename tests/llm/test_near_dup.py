"""Near-duplicate groups against comparison of all pairs."""

import random

import pyarrow as pa
import pytest

from corpuslens.llm import near_dup
from corpuslens.llm.graph import components


def brute(docs, percent, size):
    sets = {}
    for i, t in docs:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = list(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    comp[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 60, 200]))]
        for k in range(rng.choice([1, 1, 2, 30])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 18))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((n := n + 1, " ".join(own).replace("w1", "W1")))
    docs += [(n + 1, None), (n + 2, ""), (n + 3, "  "), (n + 4, docs[0][1]), (n + 5, "one"), (n + 6, "One")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("percent", "shingle", "few"), [(80, 2, False), (80, 5, True)])
def test_equals_brute_force(spark, monkeypatch, percent, shingle, few):
    if few:  # leader rounds, as for groups that are too large to list
        monkeypatch.setattr(near_dup, "LIST_PER_ROW", 0)
        monkeypatch.setattr(near_dup, "LEADER_ROUNDS", 2)
    docs = corpus(shingle)
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, component_id int")
    got = near_dup.near_duplicates(df, percent=percent, shingle=shingle).collect()
    want = brute(docs, percent, shingle)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, shingle=2).collect()), key=str)
    assert got == [(2, 2, True), (4, 2, False), (4, 2, False), (None, None, True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.id: r.comp for r in components(links).collect()} == dict.fromkeys(range(n + 1), 0)


@pytest.mark.parametrize("n", range(7))
def test_batches_of_few_words(n):
    """A batch may hold fewer words in all than one shingle."""
    words = [f"w{k}" for k in range(n)]
    (got,) = near_dup.shingle_sets(pa.array([" ".join(words)]), 5)
    assert len(got) == (max(1, n - 4) if n else 0)
    long = near_dup.shingle_sets(pa.array([" ".join(words), "a b c d e f g h"]), 5)[0]
    assert got.tolist() == long.tolist()


def test_table_of_few_words(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, 3)}


def test_large_group_of_near_copies(spark):
    """50,000 different texts around one: a single component, without pairs inside it."""
    base = [f"w{k}" for k in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 50_000):
        own = list(base)
        own[i % 60] = f"x{i}"
        docs.append((i, " ".join(own)))
    docs += [(60_000 + k, " ".join(f"y{k}z{j}" for j in range(30))) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, shingle=2).collect()}
    assert got == {i: 0 if i < 50_000 else i for i, _ in docs}


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c d"), (5, "p q r s"), (3, "a b c d"), (9, "p q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, shingle=2).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]
    assert sorted(r.doc_id for r in near_dup.keep_one(df, shingle=2).collect()) == [3, 5, 5]


def test_sketches_never_drop_a_link():
    """Sets at and above the threshold, whole and sampled, pass the sketch test."""
    import numpy as np

    rng, sketcher = np.random.default_rng(5), near_dup.Sketcher()
    for n in (3, 40, 900, 1_100, 9_000):
        for _ in range(30):
            both = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            x, y = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n // 8, np.uint64) * np.uint64(2) + np.uint64(1)))) for _ in range(2))
            common = len(np.intersect1d(x, y))
            if 100 * common < 80 * (len(x) + len(y) - common):
                continue
            at = [near_dup.level(len(s)) for s in (x, y)]
            top = max(at)
            half = [sketcher.parity(s)[(16 if a < top else 0) : (32 if a < top else 16)] for s, a in zip((x, y), at)]
            bits = int(np.bitwise_count(half[0].view(np.uint64) ^ half[1].view(np.uint64)).sum())
            far = (len(x) + len(y)) * 20 / 180
            assert bits <= (far if not top else far / 2**top + 6 * (far / 2**top) ** 0.5)
