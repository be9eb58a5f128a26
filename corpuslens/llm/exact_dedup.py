"""Exact dedup with built-in functions only: one row of each group of equal texts stays.

Texts are equal when they are the same bytes after all white space of ASCII is deleted.
Rows are grouped by the first 128 bits of that text's SHA-256; of a group the row with
the longest original text stays (code points), then the one of smallest id. Bytes decide
in the end: every member of a group of two and more is compared with the text of the row
that stays, and a hash under which texts differ is grouped anew by whole texts.

Scale: hashes are grouped after map-side aggregation and joined by plain joins, whose hot
partitions adaptive execution splits, so a group with a third of all rows is no hot task.
Only texts of groups of two and more are moved: their hashes are broadcast where their
number is checked, and beyond that the corpus is shuffled once by its hash.

Defined cases: a null text is an empty one, and all texts without a character besides
white space are equal. A null id comes after all others. Rows that repeat an id and a
text are judged alike: all of them count in group_size, and if theirs is the id that
stays, all of them say so. Ids may be of any type that can be ordered. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Hashes of groups beyond which they are shuffled and not broadcast (16 bytes each, an id and overhead: some 20 MB).
BROADCAST_GROUPS = 200_000
WHITE = " \t\n\x0b\x0c\r"


def normal_text(text: Column) -> Column:
    """The text without its ASCII white space (one pass for each mark is less work than a translation letter by letter)."""
    for mark in WHITE:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.coalesce(text, F.lit(""))


def hash_128(sha: Column) -> Column:
    """The first 128 bits of a SHA-256 in hexadecimal digits."""
    return F.unhex(F.substring(sha, 1, 32))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = hash_128) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row. key makes the hash to group by of the SHA-256."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("normal", normal_text(F.col("text"))).withColumn("sha", F.sha2(F.col("normal").cast("binary"), 256))
    # what is least stays: the longest, then the smallest id, nulls last
    # a key that cannot be null spares the join a filter that would hash every text once more
    hashed = F.coalesce(key(F.col("sha")), F.lit(b""))
    rows = rows.select("id", F.struct((-F.length("text")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id")).alias("rank"), "normal", "sha", hashed.alias("h"))
    narrow = stored(rows.select("id", "rank", "sha", "h"), "hashed")
    of_rank = [F.count("*").alias("n"), F.min("rank").alias("best")]
    groups = stored(narrow.groupBy("h").agg(*of_rank).where("n > 1"), "groups")
    near = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    members = stored(rows.join(near(groups), "h"), "members")
    # the models and what differs are written: an aggregate beside or on top of the join would keep its hot partitions from being split
    first = stored(members.where(F.col("rank") == F.col("best")).groupBy("h").agg(F.min("normal").alias("model")), "models")
    unlike = stored(members.join(first, "h").where("normal != model").select("h"), "unlike").distinct()

    def told(found: DataFrame) -> DataFrame:
        best = F.coalesce("best", "rank")
        return found.select("id", best["id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("rank") == best).alias("kept"), F.col("sha").alias("text_sha256"))

    if unlike.isEmpty():
        return told(narrow.join(near(groups), "h", "left"))
    apart = members.drop("n", "best").join(unlike, "h", "left_semi")
    by_text = stored(apart.groupBy("h", "normal").agg(*of_rank), "by_text")
    return told(narrow.join(unlike, "h", "left_anti").join(near(groups), "h", "left")).unionByName(told(apart.join(by_text, ["h", "normal"])))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that do not stay; of rows of the id that stays all remain."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
