"""Which texts contain which patterns, as an equi-join on n-grams.

Of every pattern the gram that the fewest texts hold is its key: eight neighbouring bytes,
or three or one where the pattern is shorter. One pass over the texts counts the patterns'
grams, a second keeps of each text the key grams that it holds; they are joined with the
patterns, and containment itself is tested on what is left. So a text meets a pattern only
over a rare gram, and no text is compared with every pattern.

Windows of a text's bytes are read as integers (numpy, an Arrow batch at a time). What is
broadcast are the grams of the patterns, behind a count; beyond it patterns are taken in
blocks. A gram that many texts and many patterns share still makes a row for each pair
that it brings together, as the rarest of a pattern's grams it is as rare as can be.

Defined cases: null texts and null or empty patterns match nothing; repeated rows match
each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import spread, written

#: Bytes of a gram, the longest that fits a pattern first.
GRAMS = (8, 3, 1)
#: Grams of the patterns that tasks hold at once (8 bytes each).
BLOCK_GRAMS = 1_000_000
BATCH_BYTES = 16_000_000


def windows(data: bytes, size: int) -> np.ndarray:
    """Every `size` neighbouring bytes, as integers."""
    raw = np.frombuffer(data, np.uint8)
    n = max(0, len(raw) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | raw[i : i + n]
    return out


class _Known:
    """Grams to look for: a table of bits lets nearly all others go before the exact look."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.table = grams, np.zeros(1 << 20, bool)
        self.table[self._place(grams)] = True

    @staticmethod
    def _place(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def among(self, grams: np.ndarray) -> np.ndarray:
        """The distinct ones of these that are known."""
        some = np.unique(grams[self.table[self._place(grams)]])
        return some[self.grams[np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)] == some]


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, size, gram) of every distinct pattern (column pattern)."""
    schema = "pattern string, size int, gram long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                data = p.encode()
                size = next(s for s in GRAMS if s <= len(data))
                grams = np.unique(windows(data, size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(grams)), pa.array([size] * len(grams), pa.int32()), pa.array(grams)], ["pattern", "size", "gram"])

    return patterns.select("pattern").where("pattern <> ''").distinct().mapInArrow(cut, schema)


def _held(texts: DataFrame, grams: dict[int, np.ndarray], only_grams: bool) -> DataFrame:
    """texts (id, text) -> one row for each text and gram that it holds: (size, gram) or (id, text, size, gram)."""
    kept = [] if only_grams else [texts.schema["id"], texts.schema["text"]]
    schema = T.StructType([*kept, T.StructField("size", T.IntegerType()), T.StructField("gram", T.LongType())])
    shared = texts.sparkSession.sparkContext.broadcast(grams)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_for = {size: _Known(grams) for size, grams in shared.value.items()}
        for batch in batches:
            rows, sizes, found, weight = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for size, known in looked_for.items():
                    at = known.among(windows(data, size))
                    rows.append(np.full(len(at), i))
                    sizes.append(np.full(len(at), size, np.int32))
                    found.append(at.view(np.int64))
                    weight += 0 if only_grams else len(at) * len(data)
                if rows and (weight > BATCH_BYTES or i == batch.num_rows - 1):  # texts are repeated for each gram: a few at a time
                    take = pa.array(np.concatenate(rows))
                    own = [] if only_grams else [batch.column(0).take(take), batch.column(1).take(take)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found))], names=[f.name for f in schema])
                    rows, sizes, found, weight = [], [], [], 0

    return texts.mapInArrow(find, schema)


def _by_size(rows: list) -> dict[int, np.ndarray]:
    return {s: np.unique(np.array([r.gram for r in rows if r["size"] == s], np.int64).view(np.uint64)) for s in {r["size"] for r in rows}}


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts (id, text), patterns (pattern, ...) -> (id, *columns of patterns) wherever the text contains the pattern."""
    texts = spread(texts.select("id", "text").where("text is not null"), "id")
    cut = written(pattern_grams(patterns), "pattern_grams")
    blocks = 1 + cut.count() // BLOCK_GRAMS
    out = None
    for block in range(blocks):
        own = cut.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        all_grams = _by_size(own.select("size", "gram").distinct().collect())  # about BLOCK_GRAMS
        counts = _held(texts, all_grams, True).groupBy("size", "gram").agg(F.count("*").alias("n"))
        keys = written(own.join(counts, ["size", "gram"], "left").groupBy("pattern").agg(F.min_by(F.struct("size", "gram", F.coalesce("n", F.lit(0)).alias("n")), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("key")).select("pattern", "key.*"), "keys")
        key_grams = _by_size(keys.where("n > 0").select("size", "gram").distinct().collect())  # one for each pattern at most
        near = _held(texts, key_grams, False).join(keys.where("n > 0").drop("n").hint("broadcast" if blocks == 1 else "merge"), ["size", "gram"])
        found = near.where(F.contains("text", "pattern")).select("id", "pattern")
        out = found if out is None else out.unionByName(found)
    found = written(out, "containing")
    return found.join(patterns, "pattern").select("id", *patterns.columns)
