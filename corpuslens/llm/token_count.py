"""Token counts of a unigram tokenizer without its tokens.

Pieces of the vocabulary are found by one Aho-Corasick automaton. Over the positions of
a word, dynamic programming carries the best score and its number of pieces only.
Ties are the tokenizers library's: of equal scores at a position, the piece that
starts first stays; a character without a piece of its own costs the least score
less 10 and counts one token for each of its bytes. Words are parted at ASCII white
space and begin with U+2581, so a text's count is the sum of its words' counts, and a
worker computes each distinct word once while it remembers it.

The vocabulary is read from a public model file: its pieces and their stored scores.

Defined cases: a null, empty or blank text has 0 tokens; repeated rows are counted
each; words of any length are counted whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, whitespace_words

UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64
SPACE = "▁"
_KNOWN: dict[str, "UnigramCounter"] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Text pieces and scores of a sentencepiece file, in order of id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best way to cut a word, its mark included."""
        n = len(word)
        score, count = [None] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        done, alone = 0, False  # ends up to `done` are final

        def close(end: int) -> None:
            """The unknown character that ends here comes last, as it starts last."""
            if not alone:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - 1] + len(word[end - 1].encode())

        for at, (length, own) in self.automaton.iter(word):
            end = at + 1
            if end != done:
                if done:
                    close(done)
                for e in range(done + 1, end):
                    alone = False
                    close(e)
                done, alone = end, False
            start = end - length
            alone = alone or length == 1
            s = score[start] + own
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[start] + 1
        if done:
            close(done)
        alone = False
        for e in range(done + 1, n + 1):
            close(e)
        return count[n], score[n]

    def word(self, word: str) -> tuple[int, float]:
        found = self.memo.get(word)
        if found is None:
            found = self.best(SPACE + word)
            if len(word) <= MEMO_CHARS:
                self.memo[word] = found
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, scores) of a string array."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        codes, distinct, offsets = whitespace_words(texts, lower=False)
        each = [self.word(w) for w in distinct.to_pylist()]
        n = np.array([c for c, _ in each], np.int64)[codes] if each else np.zeros(0, np.int64)
        s = np.array([v for _, v in each], np.float64)[codes] if each else np.zeros(0)
        sums = lambda x: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))[offsets])
        return sums(n), sums(s)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: id, n_tokens and score (of the best segmentation of its words)."""
    arrow_batches(docs.sparkSession)
    path = model or model_path()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _KNOWN:
            _KNOWN[path] = UnigramCounter(vocabulary(path))
        for batch in batches:
            counts, scores = _KNOWN[path].texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(scores)], names=[id_col, "n_tokens", "score"])

    return source.mapInArrow(run, schema)
