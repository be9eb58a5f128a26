"""Toxicity by a noisy-channel view of disguised words.

A character language model (trigrams, with the word's edges) is counted over all
documents. Tokens that look disguised (digits or symbols among letters, a character
three times in a row, letters spelled out one by one) become a lattice: every
character may stand for the letters it resembles or for nothing, a run may be a letter
written once or twice, and joined single letters are one token. The Viterbi path under
channel and language model is the restored token. Texts are scored after restoring.

The classifier reads restored words. It is fitted on a bounded sample of labelled rows.
Toxic rows that share a MinHash band are near copies and count once, so words that merely
come along in copies of one toxic text gain nothing. A word enters the lexicon if chance
hardly explains how many of the texts that hold it are toxic, with a bound on the share
of such accidents among all words tested; texts that the words leave unexplained are
searched again. A text's score is a logistic function of the sum of its words'
log-likelihood ratios, fitted with each text's own counts left out: its slope by maximum
likelihood, its place so that the threshold falls where F1 is best.

Labels are learnt only from rows with crc32(doc_id as text) mod 3 other than 1, and ids,
languages and sources are no features.

Defined cases: a null, empty or wordless text has the score of a text without listed
words; rows with null ids or labels are not learnt from; texts labelled twice in conflict
count as both; of paths that are equally likely the one whose text sorts last is taken, and
of words that chance explains equally the one that sorts first; very long texts are read whole;
ids may be of any type; repeated rows are scored each; without toxic labels every score
is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, built, shared_value, stored, whitespace_words
from .near_dup import Sketcher, shingle_sets

#: Labelled rows of each class that the classifier is fitted on (those of smallest id hash).
MAX_LABELLED = 20_000
#: Toxic texts that a word of the lexicon stands in, their share of all that hold it, and the share of the lexicon that chance may have brought in.
MIN_SUPPORT, PURITY, CHANCE = 3, 0.5, 0.05
MEMO_WORDS = 500_000
#: Letters that a digit or symbol stands for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "(": "c", "{": "c", "[": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "¢": "c", "µ": "u", "^": "a",
}
#: Log-probabilities of the channel: a look-alike, a kept letter, a dropped mark, a dropped look-alike, a squeezed pair, a squeezed longer run.
LOOK, KEEP, DROP_MARK, DROP_LOOK, SQUEEZE_TWO, SQUEEZE = -1.0, 0.0, -0.5, -10.0, -5.0, -0.5
#: Letters that the character model tells apart: the small ones of Latin-1 and Latin Extended-A. All others are one.
ALPHABET = "".join(chr(c) for c in range(0x61, 0x180) if chr(c).isalpha() and chr(c).islower())
SYMBOLS = len(ALPHABET) + 2
EDGE = "\x02"
_DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W_].*[0-9@$!|+({\[<€£¡§¢µ^*._\-].*[^\W_]|.*[0-9@$!|+€£¡§¢][^\W\d_]|.*(.)\1\1)", re.S)
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_]|[0-9@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[0-9@$!|+])){3,}(?!\S)")
_EDGES = re.compile("^[^\\w" + re.escape("".join(LOOKS)) + "]+|[^\\w$@!]+$")
_RUN = re.compile(r"(.)\1\1", re.S)
_TRAIL = re.compile(r"[\W_]+$")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _letters() -> np.ndarray:
    """Number of every character in the model: 0 for what is no letter (a word's edge), 1 for letters of other
    alphabets, else the place in ALPHABET."""
    codes = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for k, c in enumerate(ALPHABET, 2):
        codes[ord(c)] = k
    return codes


class CharacterModel:
    """Trigram probabilities with absolute back-off to bigrams and single letters."""

    def __init__(self, trigrams: dict[int, int]):
        self.codes = {c: k for k, c in enumerate(ALPHABET, 2)}
        self.tri = trigrams
        self.ctx: dict[int, int] = defaultdict(int)
        self.bi: dict[int, int] = defaultdict(int)
        self.ctx1: dict[int, int] = defaultdict(int)
        self.uni: dict[int, int] = defaultdict(int)
        for g, n in trigrams.items():
            self.ctx[g // SYMBOLS] += n
            self.bi[g % (SYMBOLS * SYMBOLS)] += n
            self.ctx1[g // SYMBOLS % SYMBOLS] += n
            self.uni[g % SYMBOLS] += n
        self.total = sum(self.uni.values()) + len(self.uni) + 1
        self.known: dict[str, float] = {}

    def __call__(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        p = self.known.get(g)
        if p is None:
            x, y, z = (0 if i == EDGE else self.codes.get(i, 1) for i in g)
            one = (self.uni.get(z, 0) + 1) / self.total
            two = (self.bi.get(y * SYMBOLS + z, 0) + 2 * one) / (self.ctx1.get(y, 0) + 2)
            p = math.log((self.tri.get((x * SYMBOLS + y) * SYMBOLS + z, 0) + 2 * two) / (self.ctx.get(x * SYMBOLS + y, 0) + 2))
            if len(self.known) < MEMO_WORDS:
                self.known[g] = p
        return p


class Restorer:
    def __init__(self, trigrams: dict[int, int]):
        self.lm = CharacterModel(trigrams)
        self.memo: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """A lower-case token without its disguise."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            found = self.memo[token] = self._viterbi(token) if _DISGUISED.match(token) else token
        return found

    def _lattice(self, token: str) -> list[tuple[list[tuple[str, float]], int]]:
        """Steps of (choices, unused): a choice is the letters written and its log-probability."""
        steps, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            choices: list[tuple[str, float]] = []
            letters = [(c, KEEP)] if c.isalpha() else []
            letters += [(x, LOOK) for x in LOOKS.get(c, "")]
            for x, p in letters:
                choices.append((x, p + (0.0 if run == 1 else SQUEEZE_TWO if run == 2 else SQUEEZE)))
                if run > 1:
                    choices.append((x + x, p + (SQUEEZE if run > 2 else 0.0)))
            if not c.isalpha() and not (c.isdigit() and choices):
                choices.append(("", DROP_LOOK if c in LOOKS else DROP_MARK))
            steps.append((choices, run))
            i = j
        return steps

    def _viterbi(self, token: str) -> str:
        paths = {(EDGE, EDGE): (0.0, "")}
        for choices, _ in self._lattice(token):
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (score, text) in paths.items():
                for letters, p in choices:
                    x, y, s = a, b, score + p
                    for c in letters:
                        s += self.lm(x, y, c)
                        x, y = y, c
                    old = after.get((x, y))
                    new = (s, text + letters)
                    if old is None or new > old:
                        after[x, y] = new
            paths = after
        return max((s + self.lm(a, b, EDGE), text) for (a, b), (s, text) in paths.items())[1]

    def words(self, token: str) -> tuple[str, ...]:
        """Restored words of a token between white space."""
        plain = token.rstrip(".,;:?")
        if plain.isalpha() and not _RUN.search(plain):
            return (plain,)
        core = _EDGES.sub("", token)
        if not core:
            return ()
        whole = self.restore(core)
        found = _LETTERS.findall(whole)
        if whole != core:  # what looks like a mark may be one: both readings count
            bare = _TRAIL.sub("", core)
            found += _LETTERS.findall(bare if bare != core and not _DISGUISED.match(bare) else "")
            if bare != core and _DISGUISED.match(bare):
                found += _LETTERS.findall(self.restore(bare))
        return tuple(found)


def _trigram_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, grams = _letters(), np.zeros(SYMBOLS**3)
        for batch in batches:
            tokens, distinct, _ = whitespace_words(batch.column(0))
            words = distinct.to_pylist()
            if not words:
                continue
            # every token lower-cased between edges, and how often each of its characters counts
            lower = [w.lower() for w in words]
            chars = codes[np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le"), np.uint32)].astype(np.int64)
            often = np.bincount(tokens, minlength=len(words))
            weight = np.concatenate(([0], np.repeat(often, np.fromiter(map(len, lower), np.int64, len(lower)) + 1)))
            before = chars[:-1]
            ends = (chars[1:] > 0) | (before > 0)  # letters, and the edge that follows one
            first = np.where(before > 0, np.concatenate(([0], chars[:-2])), 0)
            gram = (first * SYMBOLS + before) * SYMBOLS + chars[1:]
            grams += np.bincount(gram[ends], weights=weight[1:][ends], minlength=len(grams))
        found = np.flatnonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(grams[found].astype(np.int64))], names=["g", "n"])

    return docs.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def character_counts(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Counts of all trigrams; there are at most SYMBOLS ** 3, whatever the corpus."""
    return dict(map(tuple, _trigram_counts(docs.select(F.col(text_col).cast("string"))).collect()))


def _spelled(text: str) -> list[str]:
    return [re.sub(r"[ .\-_*]", "", m[0]) for m in _SPELLED.finditer(text)]


def text_words(restorer: Restorer, tokens: list[str], spelled: list[str]) -> set[str]:
    found: set[str] = set()
    for token in tokens:
        found.update(restorer.words(token))
    for token in spelled:
        found.update((token, restorer.restore(token)))
    return found


def _labelled(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 1))
    known = known.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    parts = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(bound) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def near_copies(keys: np.ndarray) -> np.ndarray:
    """Group of each row of band keys: rows that share a band are one group, its smallest row."""
    group = np.arange(len(keys))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for band in keys.T:
        order = np.argsort(band, kind="stable")
        for i in np.flatnonzero(np.diff(band[order]) == 0):
            x, y = sorted((find(order[i]), find(order[i + 1])))
            group[y] = x
    return np.array([find(x) for x in range(len(keys))], np.int64)


def fit(docs: DataFrame, labels: DataFrame, shared, *, id_col: str, text_col: str, label_id_col: str, label_col: str, max_labelled: int, threshold: float) -> tuple[dict[str, float], float]:
    """(weight of each chosen word, log-odds of a text without any)."""
    spark = docs.sparkSession
    sample = stored(_labelled(labels, label_id_col, label_col, max_labelled), "sample")
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id").select("_label", "_text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, sketcher = built(shared, Restorer), Sketcher()
        for batch in batches:
            words, keys = [], []
            toxic = batch.column(0).to_pylist()
            pairs = shingle_sets(pc.if_else(pc.equal(batch.column(0), 1), batch.column(1), None), 2)
            for label, text, own in zip(toxic, batch.column(1).to_pylist(), pairs):
                text = text.lower()
                words.append(sorted(text_words(restorer, sorted(set(text.split())), _spelled(text))))
                keys.append(sketcher(own)[0] if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], names=["label", "words", "bands"])

    # the sample is bounded, and so are its rows
    sets = stored(rows.mapInArrow(run, "label int, words array<string>, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "features")
    toxic = sets.where("label = 1 and size(bands) > 0").select("row", "bands").collect()
    if not toxic:
        return {}, -math.inf
    # near copies of one toxic text count once: words that merely come along in them gain nothing
    group = near_copies(np.array([r.bands for r in toxic], np.int64))
    named = spark.createDataFrame([(r.row, int(g)) for r, g in zip(toxic, group)], "row long, group long")
    grouped = sets.select("row", "label", "words").join(F.broadcast(named), "row", "left").where("label = 0 or group is not null")
    total = lambda df: df.agg(F.count_distinct("group").alias("t"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("n")).first()
    by_word = lambda df: df.select("label", "group", F.explode("words").alias("w")).groupBy("w").agg(F.count_distinct("group").alias("t"), F.sum(1 - F.col("label")).alias("n"))
    chosen: set[str] = set()
    left, rest = grouped, total(grouped)
    n_toxic, n_clean = rest.t, rest.n
    while rest.t:  # the most telling words first, then those of the texts that they leave unexplained
        new = _telling(by_word(left), rest.t / (rest.t + rest.n)) if rest.n else set()
        if not new - chosen:
            break
        chosen |= new
        left = grouped.where(~F.arrays_overlap("words", F.array(*map(F.lit, sorted(chosen)))))
        rest = total(left)
    if not chosen:
        return {}, math.log((rest.t + 0.5) / (rest.n + 0.5))
    known = F.array(*map(F.lit, sorted(chosen)))
    counts = {r.w: (r.t, r.n) for r in by_word(grouped.withColumn("words", F.array_intersect("words", known))).collect()}
    ratio = lambda t, n: max(0.0, math.log((t + 0.5) / (n_toxic + 1) / ((n + 0.5) / (n_clean + 1))))
    # each text is judged by the others' counts, so that the scale is learnt as if it were new
    one = grouped.groupBy("label", F.coalesce("group", "row").alias("_one")).agg(F.min_by(F.array_intersect("words", known), "row").alias("words"))
    seen: dict[tuple[float, int], int] = defaultdict(int)
    for r in one.where("size(words) > 0").collect():
        seen[math.fsum(ratio(counts[w][0] - r.label, counts[w][1] + r.label - 1) for w in r.words), r.label] += 1
    seen[0.0, 1] += rest.t
    seen[0.0, 0] += rest.n
    scale = max(logistic(seen)[0], 0.1)
    return {w: scale * ratio(*counts[w]) for w in sorted(counts)}, math.log(threshold / (1 - threshold)) - scale * best_cut(seen)


def best_cut(seen: dict[tuple[float, int], int]) -> float:
    """The value above which label 1 is said with the best F1, midway between the values around it; of equals the highest."""
    values = sorted({v for v, _ in seen}, reverse=True)
    positive, hits, said, best, cut = sum(n for (_, k), n in seen.items() if k), 0, 0, -1.0, values[0]
    for v, below in zip(values, values[1:]):
        hits, said = hits + seen.get((v, 1), 0), said + seen.get((v, 1), 0) + seen.get((v, 0), 0)
        if 2 * hits / (positive + said) > best:
            best, cut = 2 * hits / (positive + said), (v + below) / 2
    return cut


def logistic(seen: dict[tuple[float, int], int]) -> tuple[float, float]:
    """Slope and intercept of the log-odds of label 1, from how often (value, label) was seen (Newton's method, slight ridge)."""
    x = np.array([v for v, _ in seen])
    y = np.array([k for _, k in seen], float)
    n = np.array(list(seen.values()), float)
    at = np.zeros(2)
    design = np.stack((x, np.ones(len(x))))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 0.01 * np.eye(2), design @ (n * (y - p)) - 0.01 * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def _telling(counts: DataFrame, share: float) -> set[str]:
    """Words whose toxic texts chance hardly explains, where `share` of all texts are toxic."""
    counts = stored(counts.where(F.col("t") + F.col("n") >= MIN_SUPPORT), "counts")
    t, n = F.col("t"), F.col("n")
    rate = t / (t + n)
    # Chernoff's bound of so many toxic texts among those that hold the word
    bound = F.exp(-(t * F.log(rate / share) + F.when(n > 0, n * F.log((1 - rate) / (1 - share))).otherwise(0.0)))
    likely = counts.where((t >= MIN_SUPPORT) & (rate >= PURITY)).select(bound.alias("p"), "w").where(F.col("p") <= CHANCE)
    tests, found = counts.count(), sorted(map(tuple, likely.collect()))
    # as many as keep the expected share of chance words at CHANCE (Benjamini and Hochberg)
    last = max((k for k, (p, _) in enumerate(found, 1) if p <= CHANCE * k / tests), default=0)
    return {w for _, w in found[:last]}


def _finder(lexicon: dict[str, float]):
    """The words of the lexicon inside spelled-out letters, whatever stands around them."""
    long = [w for w in lexicon if len(w) >= 4]
    if not long:
        return lambda letters: ()
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in long:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda letters: {w for _, w in automaton.iter(letters)}


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
    threshold: float = 0.7, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """Per document: id, held_out, score, predicted and matched (its chosen features)."""
    arrow_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = shared_value(docs.sparkSession, character_counts(docs, text_col))
    lexicon, base = fit(docs, labels, shared, id_col=id_col, text_col=text_col, label_id_col=label_id_col, label_col=label_col, max_labelled=max_labelled, threshold=threshold)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, matched array<string>"
    model = sc.broadcast((lexicon, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, (lexicon, base) = built(shared, Restorer), model.value
        memo: dict[str, tuple[str, ...]] = {}
        inside = _finder(lexicon)
        for batch in batches:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            texts = batch.column(1)
            codes, distinct, offsets = whitespace_words(texts)
            hits: list[tuple[str, ...]] = []
            for token in distinct.to_pylist():
                found = memo.get(token)
                if found is None:
                    found = memo[token] = tuple(sorted({w for w in restorer.words(token.lower()) if w in lexicon}))
                hits.append(found)
            marked = np.flatnonzero(np.array([bool(h) for h in hits], bool)[codes]) if len(codes) else np.zeros(0, np.int64)
            owner = np.searchsorted(offsets, marked, "right") - 1
            sets: list[set[str]] = [set() for _ in range(len(texts))]
            for at, row in zip(marked.tolist(), owner.tolist()):
                sets[row].update(hits[codes[at]])
            for row, text in enumerate(texts.to_pylist()):
                for token in _spelled(text.lower()):
                    for whole in {token, restorer.restore(token)}:
                        sets[row].update(inside(whole))
            scores = [0.0 if base == -math.inf else 1 / (1 + math.exp(min(700.0, -(base + sum(lexicon[w] for w in sorted(found)))))) for found in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([sorted(s) for s in sets], pa.list_(pa.string()))], names=[id_col, "score", "matched"])

    scored = source.mapInArrow(run, schema)
    held = F.coalesce(fold(F.col(id_col)) == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matched")
