"""Exact tokenizer ids for columns of texts, each distinct white-space chunk encoded once.

The word_bpe tokenizer never merges across white space, so the ids of a text are the
ids of its chunks one after another. Chunks are found and numbered by Arrow kernels;
only chunks that the worker has not met are given to the tokenizers library.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import whitespace_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks of one of the memo's two generations (about 200 bytes each): a full young one becomes the old one,
#: and chunks met again move back, so frequent words are never encoded anew.
MEMO_CHUNKS = 250_000
#: A chunk longer than this is encoded each time, so that the memo stays small.
MEMO_CHARS = 64
_KNOWN: dict[str, "ChunkTokenizer"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_tokenizer(path: str) -> "ChunkTokenizer":
    """One per worker process and path; the memo lives as long as the worker."""
    if path not in _KNOWN:
        _KNOWN[path] = ChunkTokenizer(path)
    return _KNOWN[path]


class ChunkTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        # every piece of the pre-tokenizer's pattern ends with an id of this suffix
        spec = json.loads(self.full.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("a tokenizer whose words end with a suffix is needed")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = self.full.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}
        self._turn()

    def _turn(self) -> None:
        """The young generation becomes the old one."""
        self.old = (self.memo, *(getattr(self, k, np.zeros(0, np.int64)) for k in ("starts", "lens", "arena")))
        self.memo = {}
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int64)
        self.n = 0
        self.arena = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """Append the ids of several chunks; returns the number of the first."""
        first, more = self.n, len(lens)
        if first + more > len(self.starts):
            size = max(2 * len(self.starts), first + more)
            self.starts, self.lens = np.resize(self.starts, size), np.resize(self.lens, size)
        if self.used + len(ids) > len(self.arena):
            self.arena = np.resize(self.arena, max(2 * len(self.arena), self.used + len(ids)))
        self.arena[self.used : self.used + len(ids)] = ids
        ends = self.used + np.cumsum(lens)
        self.starts[first : first + more], self.lens[first : first + more] = ends - lens, lens
        self.n, self.used = first + more, self.used + len(ids)
        return first

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of new chunks, in the order of the third array. Printable chunks of characters below U+0180,
        which the normaliser only lower-cases, go together; the ids that close a piece tell them apart."""
        joint, alone, counts = [], [], []
        for i, c in enumerate(chunks):
            if not (c.isascii() or max(c) < "ƀ" and "İ" not in c):
                alone.append(i)
            elif c.isalpha():
                joint.append(i)
                counts.append(1)
            elif c.isprintable():
                joint.append(i)
                counts.append(len(self.pieces.findall(c)))
            else:
                alone.append(i)
        order = np.array(joint + alone, np.int64)
        texts = [" ".join([chunks[i] for i in joint[k : k + 500]]).lower() for k in range(0, len(joint), 500)]
        found = [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = [np.concatenate(found) if found else np.zeros(0, np.uint32)]
        closing = np.concatenate(([-1], np.flatnonzero(self.closes[ids[0]])))
        last = np.cumsum(np.array(counts, np.int64))
        if len(closing) - 1 != (int(last[-1]) if len(last) else 0):
            raise ValueError("pieces and ids do not agree")
        lens = [np.diff(closing[last], prepend=-1)]
        for i in alone:
            got = np.array(self.full.encode(chunks[i], add_special_tokens=False).ids, np.uint32)
            ids.append(got)
            lens.append(np.array([len(got)]))
        return np.concatenate(ids), np.concatenate(lens), order

    def _found(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks that the young generation lacks: moved from the old one, or encoded."""
        memo, starts, lens, arena = self.old
        before = np.fromiter(map(memo.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.empty(len(chunks), np.int64)
        known = np.flatnonzero(before >= 0)
        if len(known):
            sizes = lens[before[known]]
            ends = np.cumsum(sizes)
            first = self._add(arena[np.repeat(starts[before[known]] - (ends - sizes), sizes) + np.arange(int(ends[-1]))], sizes)
            at[known] = np.arange(first, first + len(known))
        new = np.flatnonzero(before < 0)
        if len(new):
            ids, sizes, order = self._encode_new([chunks[i] for i in new])
            first = self._add(ids, sizes)
            at[new[order]] = np.arange(first, first + len(new))
        self.memo.update((w, n) for w, n in zip(chunks, at.tolist()) if len(w) <= MEMO_CHARS)
        return at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array; a null text is empty; end_id closes each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~special), texts, pa.scalar("", pa.large_string())) if special.any() else texts
        codes, distinct, offsets = whitespace_words(plain)
        if self.n > MEMO_CHUNKS:
            self._turn()
        words = distinct.to_pylist()
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = self._found([words[i] for i in missing])
        number = at[codes]
        if end_id is not None:
            end = self._add(np.array([end_id], np.uint32), np.array([1]))
            number = np.insert(number, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        lens = self.lens[number]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if total + self.used < 1 << 31 else np.int64
        pos = np.repeat((self.starts[number] - (ends - lens)).astype(narrow), lens)
        pos += np.arange(total, dtype=narrow)
        ids = np.take(self.arena, pos)
        bounds = np.concatenate(([0], ends))[offsets]
        if special.any():
            parts, lengths = [], []
            for i in range(len(texts)):
                part = ids[bounds[i] : bounds[i + 1]]
                if special[i]:
                    own = self.full.encode(texts[i].as_py(), add_special_tokens=False).ids
                    part = np.array(own + ([] if end_id is None else [end_id]), np.uint32)
                parts.append(part)
                lengths.append(len(part))
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))
        return ids, bounds
