"""Snapshots of a table as hash trees, and the changes between two of them.

A row's hash covers its id and content hash. Rows are dealt into stripes by a hash of the
id, named by hexadecimal digits; a stripe's hash is made of sums of its rows' hashes, so it
is aggregated before the shuffle and no stripe is gathered or sorted. A node's hash covers
its up to sixteen children, up to the root. Equal tables have equal roots.

Two snapshots are compared from the root: only children of nodes that differ are looked
at, and only rows of stripes that differ are read. Rows lie in folders by the first two
digits of their stripe, sorted by stripe, so folders without a change are not opened.

Defined cases: rows that share an id are compared by the sum of their hashes, so repeats
count; a null id is an id; a null content hash is a value of its own. Snapshots must be of
one depth. An empty table is a root without children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from .scratch import written

#: Rows that a stripe holds in the mean, and hexadecimal digits that name a folder at most.
STRIPE_ROWS, FOLDER_DIGITS = 256, 2
#: Differing stripes beyond which they are joined by a shuffle.
BROADCAST_STRIPES = 200_000
WORDS = 8


def _row_hash(*parts: Column) -> Column:
    return sha256(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))


def _sums(h: str) -> list[Column]:
    """Sums of the words of 32 bits of a hexadecimal hash; they stay exact up to 2^31 rows."""
    return [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(WORDS)]


def _digest(*parts: str) -> Column:
    return F.substring(sha256(F.concat_ws(":", *parts)), 1, 32)


def depth_for(n_rows: int) -> int:
    """Digits of a stripe's name; a folder's has one less."""
    digits = 2
    while n_rows > STRIPE_ROWS * 16**digits:
        digits += 1
    return digits


class Snapshot:
    """A hash tree in a folder: rows/ (id, content_hash, stripe by folder) and nodes/ (level, node, hash, n)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes")

    def root(self) -> str:
        return self.nodes().where("level = 0").first().hash

    def depth(self) -> int:
        return self.nodes().agg(F.max("level")).first()[0]

    @classmethod
    def take(cls, rows: DataFrame, folder: str, digits: int | None = None) -> Snapshot:
        """Of rows (id, content_hash). Snapshots that are compared must name stripes by as many digits."""
        spark = rows.sparkSession
        n_rows = rows.count()
        digits = digits or depth_for(n_rows)
        stripe = F.substring(sha256(F.coalesce(F.col("id").cast("string"), F.lit("\x1e"))), 1, digits)
        dealt = rows.select("id", "content_hash", stripe.alias("stripe")).withColumn("folder", F.substring("stripe", 1, min(digits - 1, FOLDER_DIGITS)))
        # folders of an empty table would tell no columns
        dealt.hint("rebalance", "folder").sortWithinPartitions("folder", "stripe").write.partitionBy(*["folder"] * (n_rows > 0)).parquet(f"{folder}/rows")
        made = cls(spark, folder)
        each = made.rows().select("stripe", _row_hash(F.col("id"), F.col("content_hash")).alias("h"))
        leaves = each.groupBy("stripe").agg(F.count("*").alias("n"), *_sums("h"))
        level = written(leaves.select(F.lit(digits).alias("level"), F.col("stripe").alias("node"), _digest("n", *[f"s{i}" for i in range(WORDS)]).alias("hash"), "n"), "leaves")
        levels = [level]
        for k in range(digits - 1, -1, -1):  # sixteen children at most
            child = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws("=", c["node"], c["hash"])), ":")
            level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(child.alias("children"), F.sum("n").alias("n"))
            level = written(level.select(F.lit(k).alias("level"), "node", _digest("children").alias("hash"), "n"), "level")
            levels.append(level)
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        if out.isEmpty():
            out = spark.range(1).select(F.lit(0).alias("level"), F.lit("").alias("node"), _digest().alias("hash"), F.lit(0).cast("long").alias("n"))
        out.sortWithinPartitions("level", "node").write.parquet(f"{folder}/nodes")
        return made


def differing_stripes(old: Snapshot, new: Snapshot) -> DataFrame:
    """(stripe) of the leaves that differ, found from the root down."""
    depth = max(old.depth(), new.depth())
    a, b = old.nodes(), new.nodes()
    open_ = None
    for level in range(depth + 1):
        at = lambda df: df.where(F.col("level") == level).select("node", "hash")  # noqa: B023, E731
        x, y = at(a), at(b)
        if open_ is not None:  # children of differing nodes only
            near = lambda df: df.join(F.broadcast(open_) if n_open <= BROADCAST_STRIPES else open_, F.substring("node", 1, level - 1) == open_["parent"], "left_semi")  # noqa: B023, E731
            x, y = near(x), near(y)
        both = x.withColumnRenamed("hash", "was").join(y.withColumnRenamed("hash", "now"), "node", "full")
        open_ = written(both.where(~F.col("was").eqNullSafe(F.col("now"))).select(F.col("node").alias("parent")), "open")
        n_open = open_.count()
        if not n_open:
            break
    return open_.select(F.col("parent").alias("stripe"))


def changes(old: Snapshot, new: Snapshot) -> tuple[DataFrame, dict[str, int]]:
    """((id, change: added, changed, removed), how many stripes and folders were read of how many)."""
    stripes = differing_stripes(old, new)
    named = min(max(old.depth(), new.depth()) - 1, FOLDER_DIGITS)
    folders = [r[0] for r in stripes.select(F.substring("stripe", 1, named).alias("f")).distinct().collect()]  # 256 at most
    n = stripes.count()

    def side(s: Snapshot, name: str) -> DataFrame:
        rows = s.rows().where(F.col("folder").cast("string").isin(folders) if folders else F.lit(False))
        rows = rows.join(F.broadcast(stripes) if n <= BROADCAST_STRIPES else stripes, "stripe", "left_semi").select("id", _row_hash(F.col("id"), F.col("content_hash")).alias("h"))
        return rows.groupBy("id").agg(_digest_of(rows).alias(name))

    was, now = side(old, "was"), side(new, "now")
    both = was.select(F.col("id").alias("was_id"), "was").join(now, F.col("was_id").eqNullSafe(F.col("id")), "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    found = both.select(F.coalesce("id", "was_id").alias("id"), kind.alias("change")).where("change is not null")
    whole = new.nodes().where(F.col("level") == new.depth()).count()
    return found, {"stripes": whole, "stripes_read": n, "folders_read": len(folders)}


def _digest_of(rows: DataFrame) -> Column:
    return sha256(F.concat_ws(":", F.count("*"), *[F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")) for i in range(WORDS)]))
