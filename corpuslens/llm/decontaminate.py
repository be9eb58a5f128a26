"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z, so a text is
normalised to its words parted by single spaces. The patterns are the windows of
`window` consecutive words of each benchmark item (a shorter item is one window);
the automaton reads the normalised text once and reports every occurrence. Counting
spaces turns a match into word positions, and a second pass over the few texts with
matches maps those words to character offsets of the original.

Defined cases: a null or wordless text has no words, no hits and no items; items
without words have no windows; an item without an id still marks words but is not
listed; a window of several items counts for each, and ids that read alike are one;
windows that overlap or touch make one range; very long texts and items are read whole;
null ids and repeated rows are judged each for itself; extra columns are ignored; empty
tables give an empty result, or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, built, shared_value, stored

#: Characters of benchmark text whose windows one automaton holds at once (at a window of ten words up to ten
#: nodes a character, about 0.5 GB). A larger benchmark's automaton is held in parts of this size, one after
#: another; each pass adds to what the one before found, row by row.
MAX_AUTOMATON_CHARS = 1_000_000
_KEEP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


def item_windows(items: list[tuple[object, str | None]], window: int) -> dict[str, set[str]]:
    """Pattern (a latin-1 view of its bytes, with a space at either end) -> item ids."""
    found: dict[str, set[str]] = {}
    for item_id, text in items:
        words = normal_words(text or "")
        for i in range(max(1, len(words) - window + 1) if words else 0):
            key = (b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1")
            ids = found.setdefault(key, set())
            if item_id is not None:
                ids.add(str(item_id))
    return found


class Scanner:
    """The automaton and what it says of one text."""

    def __init__(self, windows: dict[str, set[str]]):
        import ahocorasick

        self.automaton = None
        if windows:
            self.automaton = ahocorasick.Automaton()
            for key, ids in windows.items():
                self.automaton.add_word(key, (len(key), key.count(" ") - 1, tuple(sorted(ids))))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged [from, to) word ranges that are hit, and items."""
        words = normal_words(text) if text else []
        if not words or self.automaton is None:
            return len(words), [], set()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ranges, items, at, seen = [], set(), 0, 0
        for end, (chars, n, ids) in self.automaton.iter(line):
            seen += line.count(" ", at, end)  # spaces before the pattern's last one
            at = end
            ranges.append((seen - n, seen))
            items.update(ids)
        return len(words), _union(ranges), items


def spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character offsets of the original text."""
    if not ranges:
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def _scanner(held: tuple[list[tuple[object, str | None]], int]) -> Scanner:
    return Scanner(item_windows(*held))


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """(broadcast item texts of bounded size, more to come); each is made when the one before is done with."""
    spark, held, size = benchmark.sparkSession, [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        if held and size + len(row[1] or "") > max_chars:
            yield shared_value(spark, (held, window)), True
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    yield shared_value(spark, (held, window)), False


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_chars: int = MAX_AUTOMATON_CHARS,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids of items with an occurring
    window) and spans (merged character ranges of the original text that are hit)."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema[0].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(shared: Broadcast, more: bool):
        """Adds what this part finds to what earlier parts found; the last part maps it to the text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = built(shared, _scanner)
            for batch in batches:
                texts = batch.column(1)
                columns: list[list] = [[], [], [], []]
                earlier = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_columns > 2 else repeat(([], []))
                for text, (old_ranges, old_items) in zip(texts.to_pylist(), earlier):
                    n, ranges, items = scanner.scan(text)
                    if old_ranges:
                        ranges = _union(ranges + [(r["start"], r["end"]) for r in old_ranges])
                    found = ([{"start": a, "end": b} for a, b in ranges] if more else spans(text or "", ranges), sorted({*items, *old_items}))
                    for column, value in zip(columns, (n, sum(b - a for a, b in ranges), *found)):
                        column.append(value)
                n_words, n_hit, ranges, items = columns
                if more:
                    yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(ranges, pair), pa.array(items, pa.list_(pa.string()))], names=[id_col, "text", "ranges", "items"])
                else:
                    arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, pair)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_hit", "items", "spans"])

        return run

    for shared, more in _parts(benchmark, item_col, item_text_col, window, max_chars):
        if not more:
            return source.mapInArrow(scan(shared, False), f"`{id_col}` {id_type}, {HITS}")
        between = f"`{id_col}` {id_type}, text string, ranges array<struct<start:long,end:long>>, items array<string>"
        source = stored(source.mapInArrow(scan(shared, True), between), "scanned")
        shared.unpersist()
    raise AssertionError("a last part always comes")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_chars: int = MAX_AUTOMATON_CHARS
) -> DataFrame:
    """The rows of docs, all their columns as they are, whose text holds no window."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = built(shared, _scanner)
            for batch in batches:
                clean = [not scanner.scan(text)[1] for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for part, more in _parts(benchmark, item_col, item_text_col, window, max_chars):
        docs = docs.mapInArrow(keep(part), docs.schema)
        if more:
            docs = stored(docs, "scanned")
            part.unpersist()
    return docs
