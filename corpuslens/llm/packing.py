"""Hierarchical multi-length packing of token sequences.

Every document is cut into full windows of the longest tier; its remainder is routed
to the smallest tier that holds it. Tiers are packed from the longest down: a window
opens with a remainder of its own tier and its gap is filled from shorter tiers, a
last filler being cut where the window ends (what is left of it is routed anew).
Windows have the exact length of their tier, a power of two, so nothing is padded;
the few tokens left when a partition ends are cut into powers of two as well.
Sequences of one tier are dealt into step groups of equal token count; the last few of a
partition share one group of less.

Each partition is packed on its own as it streams by: no shuffle, no driver, memory
bounded by one Arrow batch. Sequence ids carry the partition number in their high bits.

Defined cases: a null or empty text is one end token; remainders of equal length are
packed in the order they came; repeated rows are packed each;
a null id stays null; very long texts become many full windows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .wordtok import chunk_tokenizer, tokenizer_path

TIERS = (2048, 1024, 512, 256)
#: Tokens of one step group: that many sequences of a tier make one training step's shape.
STEP_TOKENS = 16_384
SEQUENCE_BITS = 33


class Packer:
    """Takes documents' (key, ids) and emits pieces
    (key, start, ids, doc_tokens, sequence, offset, tier, group)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers must be descending powers of two")
        self.tiers, self.step_tokens = tiers, step_tokens
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.sequences, self.groups, self.in_group = 0, 0, {}
        self.out: list[tuple] = []

    def _tier(self, n: int) -> int:
        return next((t for t in reversed(self.tiers) if t >= n))

    def _route(self, item: tuple) -> None:
        self.pools[self._tier(len(item[2]))].append(item)

    def add(self, key: object, ids: np.ndarray) -> None:
        longest, n = self.tiers[0], len(ids)
        full = n - n % longest
        for start in range(0, full, longest):
            self._close([(key, start, ids[start : start + longest], n)], longest)
        if full < n:
            self._route((key, full, ids[full:], n))

    def _close(self, pieces: list[tuple], tier: int, shape: int | None = None) -> None:
        """Number the sequence and its step group, and place its pieces. Groups are of one shape, its tier if none is named."""
        shape = tier if shape is None else shape
        group, held = self.in_group.get(shape, (None, 0))
        if group is None or held + tier > self.step_tokens:
            group, held = self.groups, 0
            self.groups += 1
        self.in_group[shape] = (group, held + tier)
        offset = 0
        for key, start, ids, n in pieces:
            self.out.append((key, start, ids, n, self.sequences, offset, tier, group))
            offset += len(ids)
        self.sequences += 1

    def _filler(self, gap: int, tier: int) -> tuple | None:
        """The longest tier's remainder that fits the gap whole, else one to be cut."""
        for t in self.tiers:
            if t <= gap and self.pools[t]:
                return self.pools[t].popleft()
        for t in reversed(self.tiers):
            if t <= tier and self.pools[t]:
                return self.pools[t].popleft()
        return None

    def _fill(self, tier: int) -> bool:
        """One window of this tier; False, with all put back, if tokens run out."""
        pieces, gap = [], tier
        item = self.pools[tier].popleft()
        while item is not None:
            key, start, ids, n = item
            pieces.append((key, start, ids[:gap], n))
            if len(ids) > gap:
                self._route((key, start + gap, ids[gap:], n))
            gap -= min(gap, len(ids))
            if not gap:
                self._close(pieces, tier)
                return True
            item = self._filler(gap, tier)
        for piece in pieces:
            self._route(piece)
        return False

    def pack(self) -> None:
        """Fill windows while the pools hold enough for one."""
        for tier in self.tiers:
            while self.pools[tier] and self._fill(tier):
                pass

    def finish(self) -> None:
        """Cut what is left into power-of-two sequences."""
        self.pack()
        rest = [item for tier in self.tiers for item in self.pools[tier]]
        left = sum(len(i[2]) for i in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces, gap = [], min(size, self.tiers[0])
            size = gap
            while gap:
                key, start, ids, n = rest.pop(0)
                pieces.append((key, start, ids[:gap], n))
                if len(ids) > gap:
                    rest.insert(0, (key, start + gap, ids[gap:], n))
                gap -= len(pieces[-1][2])
            self._close(pieces, size, 0)  # the remainders of a partition share a group
            left -= size
        self.pools = {t: deque() for t in self.tiers}

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (length of its sequence) and step_group."""
    arrow_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        tok, packer, kind = chunk_tokenizer(path), Packer(tiers, step_tokens), None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            lengths = np.array([len(x) for x in cols[2]], np.int64)
            data = np.concatenate(cols[2]).astype("<u4") if rows else np.zeros(0, "<u4")
            offsets = np.concatenate(([0], np.cumsum(lengths * 4))).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            put = lambda i, add=0: pa.array(np.array(cols[i], np.int64) + add)
            arrays = [pa.array(cols[0], kind), put(1), pa.array(lengths), ids, put(3), put(4, base), put(5), pa.array(np.array(cols[6], np.int32)), put(7, base)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.column(0).type
            ids, bounds = tok.encode(batch.column(1), end_id)
            for i, key in enumerate(batch.column(0).to_pylist()):
                packer.add(key, ids[bounds[i] : bounds[i + 1]])
            packer.pack()
            yield emit(packer.take())
        packer.finish()
        if packer.out:
            yield emit(packer.take())

    return source.mapInArrow(run, schema)
