"""Restoring disguised words, and held-out accuracy of the classifier."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from corpuslens.llm import toxicity

BAD = ["idiot", "worthless", "stupid", "moron"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    good = ["".join(rng.choice(["the", "on", "er", "in", "st", "ra", "li"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(good) for _ in range(rng.randint(10, 40))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "!", ","])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    # copies of one toxic text: its harmless words must not become features
    rows += [(1000 + i, "qqqa qqqb idiot qqqc") for i in range(9)]
    labels += [(1000 + i, 1) for i in range(9)]
    return rows, labels


def model(texts):
    codes = {c: k for k, c in enumerate(toxicity.ALPHABET, 2)} | {toxicity.EDGE: 0}
    grams = {}
    for text in texts:
        for w in toxicity._LETTERS.findall(text.lower()):
            w = toxicity.EDGE * 2 + w + toxicity.EDGE
            for i in range(len(w) - 2):
                x, y, z = (codes.get(c, 1) for c in w[i : i + 3])
                g = (x * toxicity.SYMBOLS + y) * toxicity.SYMBOLS + z
                grams[g] = grams.get(g, 0) + 1
    return grams


def test_trigram_counts(spark):
    texts = ["The the, ñandú-x ab", None, "", "日本 b2b ÀÉ straße", "a" * 3000 + " end"]
    df = spark.createDataFrame([(t,) for t in texts] * 3, "text string")
    assert toxicity.character_counts(df, "text") == {g: 3 * n for g, n in model(t for t in texts if t).items()}


def test_disguises(corpus):
    r = toxicity.Restorer(model(t for _, t in corpus[0]))
    cases = {"1d10t": "idiot", "$tup1d": "stupid", "stuuuupid": "stupid", "m0r0n!": "moron", "w0rthl3ss": "worthless", "i.d.i.o.t": "idiot", "st-up-id": "stupid", "idiot": "idiot", "(m0ron)": "moron"}
    for seen, meant in cases.items():
        assert meant in r.words(seen), (seen, r.words(seen))
    assert r.words("***") == () and r.words("theon,") == ("theon",) and r.words("2024") == ()
    assert "idiot" in set(toxicity._finder(dict.fromkeys(BAD, 1.0))(toxicity._spelled("so i d i o t it is")[0]))


def test_viterbi_equals_enumeration(corpus):
    """The best path of a lattice is the best of all its paths, written out."""
    r, rng = toxicity.Restorer(model(t for _, t in corpus[0])), random.Random(6)
    for _ in range(300):
        token = "".join(rng.choice("aditosr013!$.*@") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        paths = []
        for picks in itertools.product(*(choices for choices, _ in r._lattice(token))):
            text, p = "".join(x for x, _ in picks), 0.0
            walk = toxicity.EDGE * 2 + text + toxicity.EDGE
            p = sum(q for _, q in picks) + sum(r.lm(*walk[i : i + 3]) for i in range(len(walk) - 2))
            paths.append((p, text))
        best = max(p for p, _ in paths)
        if paths:
            assert r._viterbi(token) in {t for p, t in paths if p >= best - 1e-9}, token


def test_near_copies():
    keys = np.array([[1, 9], [2, 8], [1, 7], [5, 7], [6, 6]])
    assert toxicity.near_copies(keys).tolist() == [0, 1, 0, 0, 4]


def test_logistic_and_cut():
    seen = {(0.0, 0): 90, (0.0, 1): 2, (4.0, 0): 1, (4.0, 1): 10}
    scale, base = toxicity.logistic(seen)
    assert abs(1 / (1 + math.exp(-base)) - 2 / 92) < 0.01 and abs(1 / (1 + math.exp(-base - 4 * scale)) - 10 / 11) < 0.02
    assert toxicity.best_cut(seen) == 2.0


def test_held_out(spark, corpus):
    rows, labels = corpus
    extra = [(5001, "you 1d10t there"), (5002, "such a w0rthl3ss thing"), (5003, "an i d i o t is"), (5004, "qqqa qqqb qqqc"), (5005, None), (5006, ""), (5006, ""), (None, "idiot"), (5007, "stuuuupid " + "theon " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows + extra], "doc_id long, text string, score double")
    gold = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, gold).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    by_id = {r.doc_id: r.predicted for r in got}
    assert [by_id[i] for i in (5001, 5002, 5003, 5004, 5005, 5006, None, 5007)] == [1, 1, 1, 0, 0, 0, 1, 1]
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, gold.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), gold).count() == 0
