"""Conversation repair against plain searches over all edits."""

import hashlib
import heapq
import random
import re
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
WELL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows (turn, role, text) in order -> fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        cut = text.rstrip(WHITE)
        out.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(row, fault):
    """(letter, cost, role) of what may be done with a row; role None: gone."""
    yield "D", 3, None
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        yield "K", extra, row[1]
        for r in ("user", "assistant"):
            yield "R", 2 + extra, r


def every(rows):
    """All edits with at most two insertions at a place, the least of the cheapest."""
    gaps = [g for n in range(3) for g in product(("user", "assistant"), repeat=n)]
    found, best = faults(rows), None
    for picked in product(*[list(options(r, f)) for r, f in zip(rows, found, strict=True)]):
        for places in product(gaps, repeat=len(rows) + 1):
            out = [(r, "") for r in places[0]]
            audit = "I" * len(places[0])
            for (letter, _, role), row, gap in zip(picked, rows, places[1:], strict=True):
                out += ([(role, row[2])] if role is not None else []) + [(r, "") for r in gap]
                audit += letter + "I" * len(gap)
            if WELL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                key = (sum(c for _, c, _ in picked) + 2 * audit.count("I"), audit, out)
                best = min(best, key, key=lambda x: x[:2]) if best else key
    return best


def cheapest(rows):
    """The same by a search from the cheapest prefix on, for longer conversations."""
    found, heap, done = faults(rows), [(0, "", 0, "", ())], set()
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        done.add((i, last))
        for r in ("user", "assistant"):
            if r[0] in allowed[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r[0], (*out, (r, ""))))
        if i < len(rows):
            for letter, c, role in options(rows[i], found[i]):
                if role is None:
                    heapq.heappush(heap, (cost + c, audit + letter, i + 1, last, out))
                elif role[:1] and role[0] in allowed[last]:
                    heapq.heappush(heap, (cost + c, audit + letter, i + 1, role[0], (*out, (role, rows[i][2]))))


def brute(convs, search):
    """conv -> rows (turn, role, text) -> what repair_turns returns."""
    out = []
    for conv, rows in convs.items():
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r))
        turns = {r[0] for r in rows if r[0] is not None}
        found, first = faults(rows), [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, repaired = search(rows)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, [tuple(x) for x in repaired]))
    return sorted(out, key=repr)


def repaired(df, **options):
    return sorted(((*r[:8], [tuple(x) for x in r.repaired]) for r in R.repair_turns(df, **options).collect()), key=repr)


def made(rng, longest, convs=40):
    say = lambda: rng.choice(["", " \n", "One.", "Two!", "Three? ", "Four", "Five.\n", f"{rng.random()}.", f"{rng.random()}", None])
    role = lambda: rng.choice(["user", "assistant"] * 6 + ["system", "system", "tool", "", "u", None])
    return {c: [(rng.choice([None, i, i, i, i + 1, 3 * i]), role(), say()) for i in range(rng.randint(0, longest))] for c in [*range(convs), None]}


def frame(spark, convs):
    return spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA).repartition(3)


def test_every_edit(spark):
    convs = {c: r for c, r in made(random.Random(1), 3, 60).items() if r}
    assert brute(convs, every) == brute(convs, cheapest)
    assert repaired(frame(spark, convs).withColumns({"stripe": F.lit(1), "row": F.lit(2), "conv": F.lit(3), "there": F.lit(False)})) == brute(convs, every)


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_stripes(spark, monkeypatch, bits):
    """However a conversation is dealt into stripes, the edits are the same."""
    monkeypatch.setattr(R, "STRIPE_BITS", bits)
    convs = {c: r for c, r in made(random.Random(bits), 40).items() if r}
    assert repaired(frame(spark, convs)) == brute(convs, cheapest)


def test_long_conversation(spark):
    """One conversation of many turns, a very long text, and rows that repeat a thousand times."""
    rng = random.Random(5)
    convs = {1: [(i, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["a.", f"{i}.", f"{i}"])) for i in range(3000)], 2: [(0, "user", "word " * 200_000 + "."), (1, "assistant", "yes.")], 3: [(4, "user", "again.")] * 1000}
    assert repaired(frame(spark, convs)) == brute(convs, cheapest)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair_turns(empty).count() == 0
    gone = spark.createDataFrame([(7, 0, "user", "x.")], SCHEMA)
    assert repaired(gone, there=F.lit(False)) == [(7, 0, 0, 0, 0, 0, 0, "", [])]


def test_damaged(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, i]), rng.choice([None, "user", "assistant"]), rng.choice([None, "Yes. No! So?", "plain"])) for i in range(400)]
    want = []
    for c, t, role, text in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in R.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query(spark, tmp_path):
    """The query from the damaged rows on, digests included."""
    from corpuslens.llm.queries import op11_turn_repair

    rng = random.Random(12)
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {rng.random()}.") for c in range(60) for t in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {c: [] for c, *_ in rows}
    for r in R.damaged(spark.createDataFrame(rows, SCHEMA)).where("there").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text))
    want = [(*r[:8], hashlib.sha256("\n".join(f"{a}:{b}" for a, b in r[8]).encode()).hexdigest()) for r in brute(convs, cheapest)]
    assert sorted((tuple(r) for r in op11_turn_repair(spark, str(tmp_path)).collect()), key=repr) == want
