"""Units of a batch of queries in the order of a text's terms: words, beginnings and phrases
are one trie, and all places of some documents walk it together (numpy, inside tasks).

A place goes on to the next term only while some unit goes on there, so the work is that of
one look at each term, and of what begins like a unit. No term's postings are joined with
another's, however common they are. The trie is the batch's: its size is that of the units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that are walked at once (about 100 bytes each).
WALKED = 500_000


def repeated(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): the places start..start+count of each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def pieces(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring rows (from, to) of about `most` together; a larger row is a piece of its own."""
    ends = np.cumsum(size)
    out, a = [], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


def _looked_up(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place in the sorted `among`)."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[place] == keys, place


class Units:
    """keys (terms, prefix), all distinct and of one term at least: a unit's number is its place in the list."""

    def __init__(self, keys: list[tuple[tuple[str, ...], bool]]):
        exact = lambda terms, prefix: terms[:-1] if prefix else terms
        self.words = sorted({w for k in keys for w in exact(*k)})
        self.starts = sorted({terms[-1] for terms, prefix in keys if prefix})
        self.n = len(keys)
        code, start = {w: i for i, w in enumerate(self.words)}, {w: i for i, w in enumerate(self.starts)}
        edges: dict[tuple[int, int], int] = {}
        ends, begins = {}, {}
        for number, (terms, prefix) in enumerate(keys):
            node = 0
            for w in exact(terms, prefix):
                node = edges.setdefault((node, code[w]), len(edges) + 1)
            if prefix:
                begins[node, start[terms[-1]]] = number
            else:
                ends[node] = number
        by = lambda d, width: (lambda k, v: (k[o := np.argsort(k)], v[o]))(np.array([n * width + c for n, c in d], np.int64), np.array(list(d.values()), np.int64))
        self.edge, self.to = by(edges, max(1, len(self.words)))
        self.begin, self.begun = by(begins, max(1, len(self.starts)))
        self.end = np.full(len(edges) + 1, -1)
        self.end[list(ends)] = list(ends.values())
        self.has_begin = np.zeros(len(edges) + 1, bool)
        self.has_begin[[n for n, _ in begins]] = True
        self.goes_on = self.has_begin.copy()
        self.goes_on[[n for n, _ in edges]] = True
        #: Nodes of the first words; the last place is that of a word that is in no unit.
        self.first = np.full(len(self.words) + 1, -1)
        self.first[[c for n, c in edges if n == 0]] = [to for (n, _), to in edges.items() if n == 0]
        self.phrases = any(len(terms) > 1 for terms, _ in keys)
        self.lengths = [(size, [w for w in self.starts if len(w) == size]) for size in sorted({len(w) for w in self.starts})]
        self.start = start

    def known(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct terms: the word's code or -1, and (first, count, start): the beginnings that each has."""
        code = pc.fill_null(pc.index_in(terms, value_set=pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        which, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, own in self.lengths:
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(terms, 0, size), value_set=pa.array(own, pa.string())), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(at >= 0)
            which.append(hit)
            start.append(np.array([self.start[w] for w in own], np.int64)[at[hit]])
        which, start = np.concatenate(which), np.concatenate(start)
        count = np.bincount(which, minlength=len(terms))
        return code, np.cumsum(count) - count, count, start[np.argsort(which, kind="stable")]

    def singles(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, unit): the units of one term that each of distinct terms is or begins with."""
        code, first, count, start = self.known(terms)
        node = self.first[code]
        whole = np.where(node >= 0, self.end[node], -1)
        hit = np.flatnonzero(whole >= 0)
        run, place = repeated(first, count)
        ok, at = _looked_up(start[place], self.begin)  # beginnings at the root
        which, unit = np.concatenate((hit, run[ok])), np.concatenate((whole[hit], self.begun[at[ok]]))
        count = np.bincount(which, minlength=len(terms))
        return np.cumsum(count) - count, count, unit[np.argsort(which, kind="stable")]

    def found(self, terms: pa.Array, term: np.ndarray, doc: np.ndarray, pos: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(doc, unit) of every occurrence of a unit of `least` terms or more. Tokens are places among distinct
        terms, in order of documents and positions; those of no unit may be left out."""
        code, first, count, start = self.known(terms)
        word, place = code[term], (doc << 32) + pos
        docs, units = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, node, depth = np.arange(len(term)), np.zeros(len(term), np.int64), 0
        while len(at):
            if len(self.begin) and depth + 1 >= least:
                own = np.flatnonzero(self.has_begin[node])
                t = term[at[own] + depth]
                run, s = repeated(first[t], count[t])
                ok, i = _looked_up(node[own][run] * len(self.starts) + start[s], self.begin)
                docs.append(doc[at[own][run[ok]]])
                units.append(self.begun[i[ok]])
            step = word[at + depth]
            if depth == 0:
                node = self.first[step]
                ok = node >= 0
                at, node = at[ok], node[ok]
            else:
                ok, i = _looked_up(node * len(self.words) + step, self.edge)
                ok &= step >= 0
                at, node = at[ok], self.to[i[ok]]
            depth += 1
            if depth >= least:
                hit = self.end[node] >= 0
                docs.append(doc[at[hit]])
                units.append(self.end[node[hit]])
            more = self.goes_on[node] & (at + depth < len(term))
            at, node = at[more], node[more]
            more = place[at + depth] == place[at] + depth
            at, node = at[more], node[more]
        return np.concatenate(docs), np.concatenate(units)

    def counted(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, unit, times), in this order, of rows of terms."""
        out = []
        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        for a, b in pieces(size, WALKED):
            words = terms.slice(a, b - a).flatten().dictionary_encode()
            doc = np.repeat(np.arange(b - a), size[a:b])
            docs, units = self.found(words.dictionary, words.indices.to_numpy(), doc, np.arange(len(doc)))
            pair, times = np.unique(docs * self.n + units, return_counts=True)
            out.append((pair // self.n + a, pair % self.n, times))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Weights:
    """Of each unit the queries that ask for it and its weight there; queries are places in a list."""

    def __init__(self, rows: list[tuple[int, int, float]], n_units: int, queries: list, mean: float):
        rows = sorted(rows)
        self.query, self.idf = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        self.count = np.bincount(np.array([r[0] for r in rows], np.int64), minlength=n_units)
        self.start = np.cumsum(self.count) - self.count
        self.queries, self.mean = queries, mean or 1.0

    def asked(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return repeated(self.start[unit], self.count[unit])


#: What rounding to six decimals and the order of additions may change.
SLACK = 2e-6


def best(q: np.ndarray, total: np.ndarray, rank: np.ndarray | None, k: int) -> np.ndarray:
    """Places of those that may be among the k best of their query: by total, and by rank, if there is one, where totals are the same."""
    by = np.lexsort((-total, q) if rank is None else (rank, -total, q))
    q, total = q[by], total[by]
    new_q = np.concatenate(([True], q[1:] != q[:-1]))[: len(q)]
    new = new_q.copy()
    new[1:] |= total[1:] != total[:-1]
    start = lambda heads: np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))
    first = start(new_q)
    last = first + k - 1
    held = np.minimum(last, len(q) - 1)
    kth = np.where((last < len(q)) & (q[held] == q), total[held], -np.inf) if len(q) else total
    return by[(total >= kth - SLACK) & ((rank is None) | (np.arange(len(q)) - start(new) < k))]
