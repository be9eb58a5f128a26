"""Token ids in a binary file format coded by static range asymmetric numerals.

A segment holds the ids of consecutive documents in ascending id order, up to about
`segment_tokens`. Its frequency table (2^20 slots) is shared by all its blocks. A block
of `block_tokens` ids is coded on its own by `lanes` interleaved 64-bit states that
give out 32-bit words; id number t * lanes + k belongs to lane k. The block's head
keeps the final states, a CRC-32 of its body, and checkpoints (states and word
position after every `checkpoint_steps` steps) from which decoding can start, so
blocks and parts of blocks decode in parallel.

Segments are rows of Parquet files written by Spark, hence in any store and safe if
executors are lost: part (range of ids), segment_no, seg_start (ids before it within
its part), n_tokens, the documents' ids and lengths, and the coded bytes.

Defined cases: a null or empty text is the end id alone; documents with equal ids keep
together in one part in arrival order; a null id sorts first; very long texts make a
longer segment; extra columns are ignored; an empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stored
from .wordtok import chunk_tokenizer, tokenizer_path

SLOT_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 256
SEGMENT_TOKENS = 1 << 21
MAGIC = b"RANS1"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, slots of each): all symbols that occur, at least one slot each, 2^20 in sum."""
    symbols, counts = np.unique(ids, return_counts=True)
    slots = 1 << SLOT_BITS
    if len(symbols) > slots:
        raise ValueError("more different ids than slots")
    f = np.maximum(1, counts * slots // max(1, counts.sum()))
    over = int(f.sum()) - slots
    order = np.argsort(-f, kind="stable")
    if over <= 0:
        f[order[0]] -= over
    for i in order if over > 0 else ():
        cut = min(over, int(f[i]) - 1)
        f[i] -= cut
        over -= cut
        if not over:
            break
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode_block(index: np.ndarray, f: np.ndarray, c: np.ndarray, lanes: int, every: int) -> bytes:
    """index: positions in the symbol table. Coded from the last step to the first."""
    n = len(index)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # words still to come for the decoder, states
    coming = 0
    for t in range(steps - 1, -1, -1):
        own = index[t * lanes : (t + 1) * lanes]
        y, fs = x[: len(own)], f[own]
        full = y >= fs << np.uint64(63 - SLOT_BITS)
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            coming += len(words[-1])
            y[full] >>= np.uint64(32)
        q = y // fs
        y[:] = (q << np.uint64(SLOT_BITS)) + (y - q * fs) + c[own]
        if t and t % every == 0:
            marks.append((coming, x.copy()))
    marks = marks[::-1]
    payload = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = x.astype("<u8").tobytes() + b"".join(struct.pack("<Q", len(payload) - k) + s.astype("<u8").tobytes() for k, s in marks) + payload.tobytes()
    return struct.pack("<QIIII", n, lanes, every, len(marks), zlib.crc32(body)) + body


def decode_block(block: bytes, symbols: np.ndarray, f: np.ndarray, c: np.ndarray, slot: np.ndarray, checkpoint: int = 0) -> np.ndarray:
    """Ids of a block from a checkpoint on (0: from its start)."""
    n, lanes, every, marks, crc = struct.unpack_from("<QIIII", block)
    body = memoryview(block)[24:]
    if zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    words_at = lanes * 8 + marks * (8 + lanes * 8)
    words = np.frombuffer(body[words_at:], "<u4").astype(np.uint64)
    at = 0
    if checkpoint:
        place = lanes * 8 + (checkpoint - 1) * (8 + lanes * 8)
        at = struct.unpack_from("<Q", body, place)[0]
        x = np.frombuffer(body[place + 8 : place + 8 + lanes * 8], "<u8").copy()
    else:
        x = np.frombuffer(body[: lanes * 8], "<u8").copy()
    first = checkpoint * every
    out = np.empty(max(0, n - first * lanes), np.uint32)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    for t in range(first, -(-n // lanes)):
        m = min(lanes, n - t * lanes)
        y = x[:m]
        low = y & mask
        s = slot[low]
        out[(t - first) * lanes : (t - first) * lanes + m] = symbols[s]
        y[:] = f[s] * (y >> np.uint64(SLOT_BITS)) + low - c[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
    return out


def _tables(f32: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = f32.astype(np.uint64)
    return f, np.cumsum(f) - f


def encode_segment(ids: np.ndarray, lanes: int = LANES, block_tokens: int = BLOCK_TOKENS, every: int = CHECKPOINT_STEPS) -> bytes:
    """Magic, table (delta-coded symbols and slots, deflated), block directory, blocks."""
    symbols, f32 = frequencies(ids)
    f, c = _tables(f32)
    places = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    places[symbols] = np.arange(len(symbols), dtype=np.uint32)
    index = places[ids]
    blocks = [encode_block(index[k : k + block_tokens], f, c, lanes, every) for k in range(0, len(ids), block_tokens)]
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + f32.astype("<u4").tobytes())
    return MAGIC + struct.pack("<III", len(symbols), len(table), len(blocks)) + table + struct.pack(f"<{len(blocks)}I", *map(len, blocks)) + b"".join(blocks)


def decode_segment(data: bytes, blocks: list[int] | None = None) -> np.ndarray:
    """Ids of all blocks, or of those asked for."""
    if data[:5] != MAGIC:
        raise ValueError("not a segment")
    k, size, many = struct.unpack_from("<III", data, 5)
    raw = np.frombuffer(zlib.decompress(data[17 : 17 + size]), "<u4")
    symbols, f32 = np.cumsum(raw[:k], dtype=np.uint32), raw[k:]
    f, c = _tables(f32)
    slot = np.repeat(np.arange(k, dtype=np.uint32), f32)
    sizes = struct.unpack_from(f"<{many}I", data, 17 + size)
    starts = np.cumsum((17 + size + 4 * many, *sizes))
    parts = [decode_block(data[starts[b] : starts[b + 1]], symbols, f, c, slot) for b in (range(many) if blocks is None else blocks)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def decode_range(data: bytes, start: int, length: int) -> np.ndarray:
    """Ids start .. start + length of a segment: only the blocks they lie in are read, the first from the checkpoint before them."""
    if data[:5] != MAGIC:
        raise ValueError("not a segment")
    k, size, many = struct.unpack_from("<III", data, 5)
    raw = np.frombuffer(zlib.decompress(data[17 : 17 + size]), "<u4")
    symbols, f32 = np.cumsum(raw[:k], dtype=np.uint32), raw[k:]
    f, c = _tables(f32)
    slot = np.repeat(np.arange(k, dtype=np.uint32), f32)
    at, first, parts = 17 + size + 4 * many, 0, []
    for block_size in struct.unpack_from(f"<{many}I", data, 17 + size):
        n, lanes, every, marks = struct.unpack_from("<QIII", data, at)
        low, high = max(start, first), min(start + length, first + n)
        if low < high:
            mark = min(marks, (low - first) // (lanes * every))
            ids = decode_block(data[at : at + block_size], symbols, f, c, slot, mark)
            skipped = first + mark * lanes * every
            parts.append(ids[low - skipped : high - skipped])
        at, first = at + block_size, first + n
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_documents(segments: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids) of the wanted documents, out of written segments: segments without
    any are not decoded, the others only where the documents lie. A null id is not looked up."""
    keys = ["part", "segment_no"]
    places = segments.select(*keys, F.posexplode("doc_ids").alias("i", "doc_id"))  # ids alone: lengths are summed once for each segment
    ids = wanted.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    hits = places.join(ids, "doc_id").groupBy(*keys).agg(F.sort_array(F.collect_list("i")).alias("spots"))  # at most a segment's documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                spots, lens = (np.array(batch.column(c)[row].as_py(), np.int64) for c in ("spots", "doc_tokens"))
                own = batch.column("doc_ids")[row].values.take(pa.array(spots))
                data, before = batch.column("data")[row].as_py(), np.cumsum(lens) - lens
                found = [decode_range(data, int(before[i]), int(lens[i])).astype("<u4").tobytes() for i in spots]
                yield pa.RecordBatch.from_arrays([own, pa.array(lens[spots]), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    asked = segments.select(*keys, "doc_ids", "doc_tokens", "data").join(hits, keys)
    return asked.select("spots", "doc_ids", "doc_tokens", "data").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def encode_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1,
    partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """The segments of all documents, tokenized, in ascending order of id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    path = tokenizer or tokenizer_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    names = ["part", "segment_no", "seg_start", "n_tokens", "doc_ids", "doc_tokens", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tok = TaskContext.get().partitionId(), chunk_tokenizer(path)
        keys: list = []
        held: list[np.ndarray] = []
        lens: list[int] = []
        total, number, before = 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [part, number, before, len(ids), list(keys), list(lens), encode_segment(ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            ids, bounds = tok.encode(batch.column(1), end_id)
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = ids[bounds[i] : bounds[i + 1]]
                keys.append(key)
                held.append(own)
                lens.append(len(own))
                total += len(own)
                if total >= segment_tokens:
                    yield close()
                    number, before, total = number + 1, before + total, 0
                    keys, held, lens = [], [], []
            held = [np.concatenate(held)] if held else []  # lets go of the batch's own array
        if keys:
            yield close()

    return ordered.mapInArrow(run, "part int, segment_no int, seg_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, data binary")


def decode_corpus(segments: DataFrame) -> DataFrame:
    """Per document of written segments: doc_id, start, n_tokens and its ids as
    little-endian unsigned 32-bit integers. Only totals by part, one row for each
    partition that wrote, come to the driver."""
    spark = segments.sparkSession
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, run_total = [], 0
    for part, n in totals:
        bases.append((part, run_total))
        run_total += n
    base = spark.createDataFrame(bases, "part int, base long")
    names = ["part", "doc_id", "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, keys, lens, data = (batch.column(c)[row].as_py() for c in ("part", "seg_start", "doc_ids", "doc_tokens", "data"))
                ids = decode_segment(data).astype("<u4")
                ends = np.cumsum(np.array(lens, np.int64))
                if ends[-1] != len(ids):
                    raise ValueError("a segment's lengths do not add up")
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                arrays = [
                    pa.array(np.full(len(keys), part, np.int32)), pa.array(keys, pa.int64()), pa.array(before + ends - lens), pa.array(lens, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    one_by_one = segments.select("part", "seg_start", "doc_ids", "doc_tokens", "data")
    decoded = one_by_one.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the corpus in the shared folder, read the files back and decode them."""
    return decode_corpus(stored(encode_corpus(docs, **options), "segments"))
