"""Near-duplicate groups by MinHash bands and odd sketches.

Each document's set of word shingles is reduced to `bands * rows` MinHash samples;
equal bands make candidates. The set's smallest hashes (all of a small set; of a large
one those below a power of two, about 512 to 1,024 of them) are folded into a parity
bitmap, the odd sketch. The population count of two bitmaps' XOR never exceeds the
number of folded hashes that the sets do not share, and with few collisions it nearly
equals it, so candidates below the threshold are told from those above it closely,
and only the rest have their full sets compared.

Equal sets are one class, a node named by its digest; only nodes are compared. A bucket
is not compared by all its pairs: members are first compared with one of them, then, if
the bucket still spans several components, with randomly drawn ones, and at the end
what is left across components is tested by sketches, each pair in the first band it
shares. Pairs within a component cannot change the result. The sets of nodes that share
a bucket are written once, so whole texts are read twice, however many rounds follow.

Defined cases: a null or wordless text has an empty set and no links; a text of fewer
words than a shingle is one shingle; a null id gets a null component and is kept;
repeated rows get equal results, and rows of one id with different texts are judged by
their own text each; a component's id is its smallest id, so ties cannot arise; very long
texts are read whole, one set at a time in a task; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stored, whitespace_words
from .graph import components

BANDS, ROWS = 48, 6
SKETCH_BITS = 1024
#: Standard deviations that a sketch may be above what the threshold lets expect.
SIGMAS = 5.0
#: Rows of ids beyond which a table is shuffled and not broadcast (8 to 16 bytes each and overhead: below 10 MB).
BROADCAST_ROWS = 200_000
#: Pairs across components, for each node, that are left to the last step; leader rounds go on while there are more.
LIST_PER_ROW = 64
LEADER_ROUNDS = 12
#: A round that leaves more than this share of those pairs is the last: what is left has few links to find.
PROGRESS = 0.7
#: Members that follow one copy of their leader's set.
PER_SALT = 1_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WORDS = SKETCH_BITS // 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    import xxhash

    codes, distinct, offsets = whitespace_words(texts)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    joined = words.copy()
    for k in range(1, min(size, len(words))):  # no shingle is longer than all texts together
        joined[: len(words) - k] = _mix(joined[: len(words) - k] * _GOLD + words[k:])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            h = words[a]
            for w in words[a + 1 : b]:
                h = _mix(h * _GOLD + w)
            out.append(np.array([_mix(np.array([h + np.uint64(b - a)], np.uint64))[0]], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def level(size: int) -> int:
    """Halvings after which at most SKETCH_BITS hashes of a set are left to fold."""
    return max(0, (max(1, size) - 1).bit_length() - (SKETCH_BITS.bit_length() - 1))


class Sketcher:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, n = bands, rows, bits, bands * rows
        self.a = (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
        self.number = np.arange(n, dtype=np.uint64) << np.uint64(32)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, odd sketches as 64-bit words) of a set that is not empty and sorted."""
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(h), 2048):
            np.minimum(least, (self.a * h[k : k + 2048] + self.b).min(axis=1), out=least)
        samples = _mix((self.number | least) + _GOLD)
        keys = np.zeros(self.bands, np.uint64)
        for row in samples.reshape(self.bands, self.rows).T:
            keys = _mix(keys * _GOLD + row)
        return keys.view(np.int64), self.parity(shingles)

    def parity(self, shingles: np.ndarray) -> np.ndarray:
        """Bitmaps of the set at its own level and at the next, for partners that are larger."""
        own, out = level(len(shingles)), []
        for k in (own, own + 1):
            some = shingles[: np.searchsorted(shingles, np.uint64(1 << (64 - k)))] if k else shingles
            places = (_mix(some) & np.uint64(self.bits - 1)).astype(np.int64)
            out.append(np.packbits((np.bincount(places, minlength=self.bits) & 1).astype(np.uint8)).view(np.int64))
        return np.concatenate(out)


def may_reach(x: str, y: str, percent: int) -> Column:
    """Sizes n<x>, n<y>, levels l<x>, l<y> and sketches o<x>, o<y> leave the threshold possible.

    At the threshold the sets differ in at most `far` shingles. Folded whole, these set
    at most so many bits; folded from a sample, a Poisson number of which the mean is known."""
    nx, ny, lx, ly = (F.col(c) for c in (f"n{x}", f"n{y}", f"l{x}", f"l{y}"))
    far = (nx + ny) * ((100 - percent) / (100 + percent))
    at = F.greatest(lx, ly)
    mean = far / F.pow(F.lit(2.0), at)
    odd = (1 - F.exp(mean * (-2.0 / SKETCH_BITS))) / 2
    spread = odd * (1 - odd) * SKETCH_BITS
    whole = F.least(far + 1e-6, odd * SKETCH_BITS + SIGMAS * F.sqrt(F.greatest(F.lit(1.0), spread - mean * F.exp(mean * (-4.0 / SKETCH_BITS)))) + 1)
    most = F.when(at == 0, whole).otherwise(odd * SKETCH_BITS + SIGMAS * F.sqrt(spread) + 1)
    ox = lambda i: F.get(f"o{x}", F.when(lx < ly, i + _WORDS).otherwise(i))
    oy = lambda i: F.get(f"o{y}", F.when(ly < lx, i + _WORDS).otherwise(i))
    distance = sum((F.bit_count(ox(i).bitwiseXOR(oy(i))) for i in range(_WORDS)), F.lit(0))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (distance <= most)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, d1 long, bands array<long>, odd array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            sizes, d1, bands, odds = [], [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                sizes.append(len(s))
                if len(s):
                    keys, odd = sketcher(s)
                    d1.append(_digest(s))
                    bands.append(keys)
                    odds.append(odd)
                else:
                    d1.append(None)
                    bands.append([])
                    odds.append([])
            longs = pa.list_(pa.int64())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(bands, longs), pa.array(odds, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "d1", "bands", "odd"])

    return docs.mapInArrow(run, schema)


def _digest(shingles: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), np.int64)[0])


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its row count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """The shingle set of each member (doc_id, node), as bytes."""
    texts = docs.join(_small(members), "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            # an id may stand for several texts: the node is the digest of the right one
            right = [len(s) > 0 and _digest(s) == n for s, n in zip(sets, batch.column(0).to_pylist())]
            data = pa.array([s.tobytes() if ok else None for s, ok in zip(sets, right)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["node", "set"]).filter(pa.array(right, pa.bool_()))

    return texts.mapInArrow(run, "node long, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Members follow their leader's
    set in a stream dealt out by leader and salt; two sets are held at a time."""
    pairs = stored(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("n") / PER_SALT)).alias("salt"))
    salted = stored(salted, "salted")
    leader = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    member = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"))
    # repeated rows of one text give equal sets: a second leader or member says the same
    stream = leader.unionByName(member).join(sets.withColumnRenamed("node", "id"), "id").select("a", "salt", "role", "id", "set")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = None, None
        for batch in batches:
            a_out, b_out = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "id")))
            for (a, salt, role, b), data in zip(keys, batch.column(4)):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                if role == 0:
                    held, base = (a, salt), s
                    continue
                assert held == (a, salt)
                if 100 * min(len(s), len(base)) < percent * max(len(s), len(base)):
                    continue
                common = len(np.intersect1d(s, base, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(base) - common):
                    a_out.append(a)
                    b_out.append(b)
            if base is not None:
                base = base.copy()  # lets go of the batch it came in
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return stream.mapInArrow(run, "a long, b long").distinct()


def _links(nodes: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(id, comp) of all linked nodes. nodes: node, doc_id, n_shingles, bands, odd."""
    sketch = nodes.select("node", F.col("n_shingles").alias("n"), F.greatest(F.lit(0), F.length(F.bin(F.col("n_shingles") - 1)) - (SKETCH_BITS.bit_length() - 1)).alias("l"), F.col("odd").alias("o"), "bands")
    buckets = nodes.select("node", F.explode("bands").alias("b")).repartition(F.col("b"))
    shared = buckets.groupBy("b").agg(F.count("*").alias("c"), F.min("node").alias("lead")).where("c > 1").select("b", "lead")
    members = stored(buckets.join(shared.hint("merge"), "b").select("b", "node", "lead"), "members")
    taking_part = stored(members.select("node").distinct(), "taking_part")
    n_nodes = taking_part.count()
    taking_part = F.broadcast(taking_part) if n_nodes <= BROADCAST_ROWS else taking_part
    sketch = stored(sketch.join(taking_part, "node", "left_semi"), "sketch")
    own = stored(nodes.select("node", "doc_id").join(taking_part, "node", "left_semi"), "own")
    sets = stored(_sets(docs, own, shingle).dropDuplicates(["node"]), "sets")

    def with_sketch(df: DataFrame, key: str, mark: str, *more: str) -> DataFrame:
        named = [F.col(c).alias(c + mark) for c in ("n", "l", "o", *more)]
        return df.join(sketch.select(F.col("node").alias(key), *named), key)

    def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        return with_sketch(with_sketch(pairs, "a", "x"), "b", "y").where(may_reach("x", "y", percent)).select("a", "b")

    links = stored(_confirm(alike(pairs_of(members, "lead", "node")), sets, percent), "links")
    comp = stored(components(links), "comp")
    before = float("inf")
    for step in range(LEADER_ROUNDS + 1):
        named = members.select("b", "node").join(_small(comp.withColumnRenamed("id", "node")), "node", "left").select("b", "node", F.coalesce("comp", "node").alias("comp"))
        sizes = named.groupBy("b", "comp").agg(F.count("*").alias("n"))
        open_ = sizes.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.max_by("comp", "n").alias("major")).where("k > 1 and n > 2")
        open_ = stored(open_.select("b", "n", "nn", "major"), "open")
        across = open_.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2), F.lit(0.0))).first()[0]
        if not across:
            break
        last = across <= LIST_PER_ROW * n_nodes or across > PROGRESS * before or step == LEADER_ROUNDS
        before = across
        rows = named.join(open_.select("b", "major"), "b")
        if last:  # all that is left across components; one side is outside the bucket's main component
            rows = stored(with_sketch(rows, "node", "x", "bands").withColumnRenamed("node", "x"), "rows")
            minor = rows.where("comp != major").select("b", F.col("x").alias("y"), F.col("comp").alias("compy"), F.col("nx").alias("ny"), F.col("lx").alias("ly"), F.col("ox").alias("oy"), F.col("bandsx").alias("bandsy"))
            across_ = (F.col("by") == F.col("b")) & (F.col("comp") != F.col("compy")) & ((F.col("comp") == F.col("major")) | (F.col("x") < F.col("y")))
            first_shared = F.get("bandsx", F.array_position(F.zip_with("bandsx", "bandsy", lambda p, q: p == q), True).cast("int") - 1) == F.col("b")
            found = rows.withColumnRenamed("b", "by").join(minor, across_ & may_reach("x", "y", percent) & first_shared)
            new = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        else:
            order = F.xxhash64("b", "node", F.lit(step))
            lead = lambda df: df.groupBy("b").agg(F.min_by("node", order).alias("x"), F.min_by("comp", order).alias("cx"))
            leaders = lead(rows.where("comp != major")).unionByName(lead(rows.where("comp = major")))
            new = alike(pairs_of(rows.join(leaders, "b").where("comp != cx"), "node", "x"))
        found = stored(_confirm(new, sets, percent), "found")
        if found.count():
            stars = comp.select(F.col("id").alias("a"), F.col("comp").alias("b"))
            comp = stored(components(stars.unionByName(found)), "comp")
        if last:
            break
    return comp


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id linked to it, directly or
    over others) and kept (it is that smallest id). Documents are linked if
    100 * |intersection| >= percent * |union| of their shingle sets."""
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(_sketches(docs, shingle), "sketches")
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    nodes = real.groupBy("d1").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "odd")).alias("s"))
    nodes = stored(nodes.select(F.col("d1").alias("node"), "s.*"), "nodes")
    comp = _links(nodes, docs, percent, shingle)
    # a component is called by its smallest document
    classes = nodes.select("node", "doc_id").join(_small(comp.withColumnRenamed("id", "node")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")
    named = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = stored(classes.join(named, "comp").select(F.col("node").alias("d1"), "component_id"), "classes")
    out = sketches.select("doc_id", "n_shingles", "d1").join(classes, "d1", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all their columns as they are, that stand for their group: an id goes if none of its rows does."""
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = judged.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("kept")).where("not kept").select(F.col(id_col).alias("_gone"))
    gone = _small(stored(gone, "gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
