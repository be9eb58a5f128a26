"""Quality rules: base rules, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed to `buckets` cells. Their counts over all documents
give the raw multinomial; the counts over trusted documents (labelled 1) give the
target (one half of them; the other is held out for the threshold). A document's score is the sum of log(target / raw) over its n-grams, divided by their number. Ratios are rounded to
integers, so sums do not depend on order and every document is judged alike wherever
it is read. The threshold is the value that parts the labelled documents best that pass
the base rules and gave no counts.

Everything is DataFrame functions. A row's words, hashes and score are array
expressions inside the row: nothing is shuffled but counts by bucket (at most
`buckets` rows a task), and the ratios come as a one-row table of fixed size.

Defined cases: a null or wordless text has zero counts and fails; a score equal to the
threshold is kept; of thresholds that part the labelled rows equally well the lowest is
taken; very long texts are read whole; repeated rows are judged each; ids may be of any
type; labels of unknown documents and null labels are left out; without trusted rows the
base rules alone decide; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 16
#: Labelled documents of each class that the target counts and the threshold are fitted on (those of smallest id hash).
MAX_LABELLED = 20_000
#: Ratios are held as integers of this many to one.
SCALE = 10_000
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, wherever the optimizer moves the expression: written
    out, an expression used three times at each of four levels is evaluated 81 times."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def pairwise(hashes: Column, gap: int) -> Column:
    """hash(x[i], x[i + gap]) for every i."""

    def join(x: Column) -> Column:
        n = F.greatest(F.size(x) - gap, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))

    return bound(hashes, join)


def repeated_words(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs at least twice."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        add = lambda s, i: F.struct((s["n"] + (i + width) - F.greatest(s["to"], i)).alias("n"), (i + width).alias("to"))
        return F.aggregate(places, start, add, lambda s: s["n"])

    def twins(marked: Column) -> Column:
        n = F.size(marked) - 1
        same = F.zip_with(F.slice(marked, F.lit(1), n), F.slice(marked, F.lit(2), n), lambda x, y: x["h"] == y["h"])
        either = lambda after: F.transform(
            marked, lambda e, k: F.when(F.coalesce(F.get(after, k - 1), F.lit(False)) | F.coalesce(F.get(after, k), F.lit(False)), e["i"])
        )
        return bound(F.array_sort(F.array_compact(bound(same, either))), covered)

    def count(w: Column) -> Column:
        marked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(bound(marked, twins))

    return bound(windows, count)


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _text, _words, _h (word hashes) and _h2 (pair hashes)."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = docs.withColumn("_words", F.array_remove(F.split("_text", SPLIT), ""))
    docs = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return docs.withColumn("_h2", pairwise(F.col("_h"), 1))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules and base_failed to with_words()."""
    docs = docs.withColumn("_solid", without(F.col("_text"), SPACES))
    eight = pairwise(pairwise(F.col("_h2"), 2), 4)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(HAS_WORD))
    big = lambda c: c.cast("long")
    docs = docs.withColumns({
        "n_words": big(F.size("_words")),
        "word_chars": big(F.length("_solid")),
        "n_symbols": big(F.length("_solid") - F.length(without(F.col("_solid"), SYMBOLS))),
        "n_dup_lines": big(bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": big(repeated_words(eight, WINDOW)),
    })
    return docs.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most `bound` ids of each class, as text: those of smallest hash."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    parts = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(bound) for k in (0, 1)]
    # an id with both labels says nothing
    return parts[0].unionByName(parts[1]).groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, label_id_col: str, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED):
    """(integer ratios by bucket, threshold) or None without trusted rows."""
    spark = docs.sparkSession
    sample = stored(labelled_sample(labels, label_id_col, label_col, max_labelled), "sample")
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_col)
    words = with_words(rows, text_col)
    fold = F.pmod(F.xxhash64("_id"), F.lit(2))  # half of the trusted rows is kept for the threshold
    flagged = words.join(F.broadcast(sample.where((F.col("_label") == 1) & (fold == 0)).select("_id", F.lit(1).alias("_t"))), "_id", "left")
    cells = flagged.select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(F.concat("_h", "_h2")).alias("h"))
    counts = cells.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    n_raw, n_target = sum(r.raw for r in counts), sum(r.target for r in counts)
    if not n_target:
        return None
    ratios = [0] * buckets
    for r in counts:  # add-one smoothing of both multinomials
        ratios[r.b] = round(SCALE * (math.log((r.target + 1) / (n_target + buckets)) - math.log((r.raw + 1) / (n_raw + buckets))))
    # written before words are cut, or the optimizer moves the rules below the join and applies them to every row
    held_out = stored(rows.join(F.broadcast(sample.where((F.col("_label") == 0) | (fold == 1))), "_id"), "held_out")
    chosen = base_rules(with_words(held_out, text_col)).where("not base_failed")
    scored = scores(chosen, ratios).where("_n > 0").select("_label", F.floor(F.col("_sum") / F.col("_n")).cast("long").alias("s"))
    bins = sorted(scored.groupBy("s").agg(F.sum(F.col("_label")).alias("good"), F.sum(1 - F.col("_label")).alias("bad")).collect())
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    if not bad:
        return ratios, bins[0].s if bins else 0
    best, threshold, lost, caught = -1.0, bins[0].s, 0, 0
    for k, b in enumerate(bins):  # keep scores from midway between this one and the one below
        value = (good - lost) / max(1, good) + caught / bad
        if value > best:
            best, threshold = value, (b.s + bins[k - 1].s) // 2 if k else b.s
        lost, caught = lost + b.good, caught + b.bad
    return ratios, threshold


def scores(words: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds _sum and _n to with_words(). The ratios, a row of fixed size, come by an equi-join on a constant."""
    spark = words.sparkSession
    one = spark.createDataFrame([(0, ratios)], "_one int, _ratios array<int>")
    # a constant key would be folded away and leave a nested-loop join
    words = words.withColumn("_one", F.pmod(F.size("_h"), F.lit(1))).join(F.broadcast(one), "_one", "left")
    n = len(ratios)
    add = lambda s, h: s + F.get("_ratios", F.pmod(h, F.lit(n)).cast("int"))
    total = F.aggregate("_h2", F.aggregate("_h", F.lit(0).cast("long"), add), add)
    return words.withColumns({"_sum": total, "_n": (F.size("_h") + F.size("_h2")).cast("long")})


def judge_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
    buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, keep_columns: bool = False,
) -> DataFrame:
    """Per document: id, the counts of the base rules, base_failed, llr (mean ratio) and
    kept; with keep_columns the columns of docs, packed in `_row`, and kept."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, label_id_col=label_id_col, buckets=buckets, max_labelled=max_labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_columns else F.struct(F.lit(None).cast("int"))
    source = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_t"), row.alias("_row"))
    judged = base_rules(with_words(source, "_t"))
    if model is None:
        judged = judged.withColumns({"llr": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    else:
        judged = scores(judged, model[0])
        ok = F.col("_sum") >= F.lit(model[1]).cast("long") * F.col("_n")
        judged = judged.withColumns({"llr": F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / SCALE), "kept": ~F.col("base_failed") & ok})
    if keep_columns:
        return judged.select("_row", "kept")
    return judged.select(F.col("_key").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, all their columns as they are."""
    return judge_quality(docs, labels, keep_columns=True, **options).where("kept").select("_row.*")
