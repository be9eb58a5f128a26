"""The automaton against a search of every position."""

import random
import re

import pytest

from corpuslens.llm.decontaminate import drop_contaminated, find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for key, ids in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    found |= {str(x) for x in ids if x is not None}
        yield (doc_id, len(w), len(hit), sorted(found))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = ["ab", "Cd", "é", "x9", "THE", "of", "z"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, "!!"), (None, "ab Cd é x9"), (12, "the of")]
    docs = [(i, say(rng.choice([0, 2, 40, 300]))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "…—"), (103, "Start: " + items[4][1] + "; end"), (103, "Start: " + items[4][1] + "; end"), (104, "ofthe"), (105, items[4][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("max_chars", [10**6, 40])
def test_equals_brute_force(spark, case, max_chars):
    docs, items = case
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(d, b, max_chars=max_chars).collect()
    key = lambda r: (r[0], r[1], r[2], tuple(r[3]))
    assert sorted(key(r) for r in got) == sorted(map(key, brute(docs, items)))
    by_id = dict(docs)
    for r in got:
        assert sum(len(words(by_id[r.doc_id][s.start : s.end])) for s in r.spans) >= r.n_hit
    clean = sorted(i for i, _, n, _ in brute(docs, items) if not n)
    kept = drop_contaminated(d, b, max_chars=max_chars)
    assert sorted(r.doc_id for r in kept.collect()) == clean and kept.columns == d.columns


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert find_contamination(d, b).count() == 0
    assert find_contamination(one, b).collect()[0][:4] == (1, 3, 0, [])


def test_twenty_benchmarks_in_one_session(spark):
    """Workers are reused: none may answer with the automaton of an earlier benchmark."""
    rng = random.Random(9)
    items = [" ".join(f"k{k}w{rng.randrange(50)}" for _ in range(12)) for k in range(20)]
    d = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(items)] + [(None, None)], "doc_id long, text string")
    for k, t in enumerate(items):
        b = spark.createDataFrame([(k, t)], "item_id long, text string")
        assert [r.doc_id for r in find_contamination(d, b).where("n_hit > 0").collect()] == [k]
        assert sorted(r.doc_id for r in drop_contaminated(d, b).where("doc_id is not null").collect()) == [i for i in range(20) if i != k]


def test_parts_find_what_one_automaton_finds(spark, case):
    docs, items = case
    d = spark.createDataFrame([*docs, (None, items[4][1]), (None, items[4][1])], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (str(r[0]), r[1], r[2], tuple(r[3]), tuple(map(tuple, r[4])))
    whole = sorted(map(key, find_contamination(d, b).collect()))
    assert whole == sorted(map(key, find_contamination(d, b, max_chars=60).collect()))
    for _ in range(3):
        assert drop_contaminated(d, b, max_chars=60).count() == sum(1 for r in whole if not r[2])


def test_very_long_text_and_clashing_columns(spark):
    long = "a " * 300_000 + "one two three four five six seven eight nine ten" + " b" * 300_000
    d = spark.createDataFrame([(1, long, 7, "x")], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(5, "One, two three-four five six seven eight nine TEN!")], "item_id long, text string")
    (r,) = find_contamination(d, b).collect()
    assert (r.n_words, r.n_hit, r["items"]) == (600_010, 10, ["5"])
    assert long[r.spans[0].start : r.spans[0].end] == "one two three four five six seven eight nine ten"
