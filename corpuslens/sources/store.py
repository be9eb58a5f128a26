"""The corpus as Parquet tables in one folder, with upserts.

Plain Parquet has no MERGE. A table is dealt into buckets by its parent or key; a write
makes new files for the buckets it touches only, beside the old ones. One pointer file
names the files in force of all tables: it is made in one step, under the next number,
so a failed job leaves everything as it was, several tables change together, and of two
writers that start from one state the second gets an error. Files that neither the last
pointer nor the one before names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sha256, short_id

#: Key of each table, the parent whose removal removes its rows, and its column that names the parent.
TABLES: dict[str, tuple[list[str], str | None, str | None]] = {
    "sources": (["url"], None, None), "pages": (["url"], "sources", "source_id"), "links": (["page_id", "url"], "pages", "page_id"), "snapshots": (["snapshot_id"], "sources", "source_id"),
    "snapshot_pages": (["snapshot_id", "page_id"], "snapshots", "snapshot_id"), "chunks": (["chunk_id"], "pages", "page_id"), "chunk_edges": (["src", "dst", "type"], "chunks", "src"), "symbols": (["chunk_id", "name"], "chunks", "chunk_id"),
    "endpoints": (["endpoint_id"], "pages", "page_id"), "examples": (["example_id"], "pages", "page_id"), "pitfalls": (["pitfall_id"], "pages", "page_id"),
}
#: What the rows of a parent table are called by their children.
NAMED_BY = {"sources": "source_id", "pages": "page_id", "snapshots": "snapshot_id", "chunks": "chunk_id"}
#: Tables whose rows are replaced parent by parent are dealt by the parent, the others by their first key.
BY_PARENT = frozenset({"links", "chunks", "chunk_edges", "symbols", "endpoints", "examples", "pitfalls", "snapshot_pages"})
BUCKETS = 64


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the last in the order given."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._open: dict | None = None  # what a transaction has written so far

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/pointers")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, number: int) -> dict[str, dict[str, str]]:
        """table -> bucket -> folder of its files."""
        fs, p = self._fs(f"{self.folder}/pointers/{number:08d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _state(self) -> dict:
        if self._open is not None:
            return self._open
        known = self._pointers()
        return {"number": known[-1] if known else 0, "tables": self._load(known[-1]) if known else {}}

    def _publish(self, state: dict) -> None:
        number = state["number"] + 1
        fs, p = self._fs(f"{self.folder}/pointers/{number:08d}")
        out = fs.create(p, False)  # fails if another writer was first
        try:
            out.write(json.dumps(state["tables"]).encode())
        finally:
            out.close()
        for old in [n for n in self._pointers() if n < number - 1]:
            now = {v for n in (number - 1, number) for t in self._load(n).values() for v in t.values()}
            for gone in {v for t in self._load(old).values() for v in t.values()} - now:
                f, q = self._fs(gone)
                f.delete(q, True)
            fs.delete(self._fs(f"{self.folder}/pointers/{old:08d}")[1], False)

    @contextmanager
    def transaction(self) -> Iterator["Store"]:
        """All writes inside take force together, or none does."""
        if self._open is not None:  # part of the one around it
            yield self
            return
        self._open = self._state()
        try:
            yield self
            state = self._open
        finally:
            self._open = None
        self._publish(state)

    def _change(self, name: str, buckets: dict[str, str]) -> None:
        state = self._state()
        state = {"number": state["number"], "tables": {**state["tables"], name: buckets}}
        if self._open is not None:
            self._open = state
        else:
            self._publish(state)

    def parts(self, name: str) -> dict[str, str]:
        """Folders of a table in force, by name: for tables that are not dealt by keys."""
        return dict(self._state()["tables"].get(name, {}))

    def put(self, tables: dict[str, dict[str, str]]) -> None:
        """Put folders of several such tables in force at once."""
        with self.transaction():
            for name, parts in tables.items():
                self._change(name, parts)

    def _bucket(self, name: str, rows: DataFrame) -> Column:
        keys, _, parent = TABLES[name]
        return F.pmod(F.xxhash64(F.col(parent if name in BY_PARENT and parent in rows.columns else keys[0]).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def read(self, name: str) -> DataFrame | None:
        return self._read(sorted(self._state()["tables"].get(name, {}).values()))

    def _write(self, name: str, rows: DataFrame, touched: list[int] | None) -> DataFrame:
        """Files for these buckets (all, if none are named) in place of those before."""
        folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(name, rows)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        fs, p = self._fs(folder)
        new = {f.getPath().getName().split("=")[1]: f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(p) if "=" in f.getPath().getName()}
        kept = {} if touched is None else {b: v for b, v in self._state()["tables"].get(name, {}).items() if int(b) not in touched}
        if not new and not kept:  # an empty table still has its columns
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/none")
            new = {"-1": f"{folder}/none"}
        self._change(name, kept | new)
        return self.read(name)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        return self._write(name, rows, None)

    def _touched(self, name: str, rows: DataFrame) -> tuple[list[int], DataFrame | None]:
        """Buckets of the rows, and what those buckets hold now."""
        touched = [r[0] for r in rows.select(self._bucket(name, rows).alias("b")).distinct().collect()]  # as many as there are buckets
        held = self._state()["tables"].get(name, {})
        return touched, self._read([held[str(b)] for b in touched if str(b) in held])

    def upsert(self, name: str, rows: DataFrame, order: list | None = None) -> DataFrame:
        """Insert, or replace rows of the same key; of equal keys that come the last in
        `order` (by all columns, if none is given) stays."""
        keys = TABLES[name][0]
        new = latest(rows, keys, *(order or [F.xxhash64(*rows.columns)]))
        touched, old = self._touched(name, new)
        if old is not None:
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
        return self._write(name, new, touched)

    def insert_absent(self, name: str, rows: DataFrame) -> DataFrame:
        keys = TABLES[name][0]
        new = rows.dropDuplicates(keys)
        touched, old = self._touched(name, new)
        return self._write(name, new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True), touched)

    def replace_children(self, name: str, parents: DataFrame, rows: DataFrame) -> DataFrame:
        """All rows of the given parents go, and the new ones come; what refers to rows that are gone goes too."""
        parent = TABLES[name][2]
        ids = parents.select(F.col(NAMED_BY[TABLES[name][1]]).alias(parent)).distinct()
        with self.transaction():
            touched, old = self._touched(name, ids.unionByName(rows.select(parent)) if name in BY_PARENT else rows)
            new = rows if old is None else old.join(ids, parent, "left_anti").unionByName(rows, allowMissingColumns=True)
            now = self._write(name, new, touched)
            self._cascade(name, now)
        return now

    def delete(self, name: str, keep: Callable[[DataFrame], DataFrame]) -> None:
        """Reduce a table, then drop what refers to rows that are gone."""
        old = self.read(name)
        if old is None:
            return
        with self.transaction():
            self._cascade(name, self.replace(name, keep(old)))

    def _cascade(self, name: str, now: DataFrame) -> None:
        link = NAMED_BY.get(name)
        for child, (_, parent, column) in TABLES.items():
            rows = self.read(child) if parent == name else None
            if rows is not None and link in now.columns and column in rows.columns:
                known = now.select(F.col(link).alias(column)).distinct()
                if rows.join(known, column, "left_anti").take(1):
                    self._cascade(child, self.replace(child, rows.join(known, column, "left_semi")))

    def snapshot(self, source_id: str, captured_at: str, doc_version: str | None = None) -> str:
        """A snapshot is the hash of its pages' hashes by id; a version already known stays."""
        pages = self.read("pages").where(F.col("source_id") == source_id).withColumn("h", F.coalesce("content_hash", F.lit("hash_default")))
        # hashed in stripes of ids, so that no task holds the hashes of a whole source
        stripe = F.substring(sha256(F.col("page_id")), 1, 2)
        part = pages.groupBy(stripe.alias("s")).agg(F.array_sort(F.collect_list(F.struct("page_id", "h"))).alias("p"), F.count("*").alias("n"))
        part = part.select("s", sha256(F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["page_id"], x["h"])), ":")).alias("h"), "n")
        row = part.agg(F.array_sort(F.collect_list(F.struct("s", "h"))).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        made = row.select(F.substring(sha256(F.concat_ws(":", F.lit(source_id), F.array_join(F.transform("p", lambda x: x["h"]), ":"))), 1, 16).alias("id"), "n").first()
        old = self.read("snapshots")
        known = old.where(F.col("snapshot_id") == made.id).select("doc_version").first() if old is not None else None
        version = doc_version or (known.doc_version if known else None)
        self.upsert("snapshots", self.spark.createDataFrame([(made.id, source_id, captured_at, version, made.n)], "snapshot_id string, source_id string, captured_at string, doc_version string, page_count long"))
        self.upsert("snapshot_pages", pages.select(F.lit(made.id).alias("snapshot_id"), "page_id", F.coalesce("content_hash", F.lit("hash_default")).alias("content_hash")))
        return made.id

    def latest_snapshots(self) -> DataFrame:
        return latest(self.read("snapshots"), ["source_id"], F.desc("captured_at"), F.desc("snapshot_id"))

    def stats(self) -> DataFrame:
        """(table, n) of every table that was written."""
        rows = [self.read(n).select(F.lit(n).alias("table")) for n in TABLES if n in self._state()["tables"]]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.groupBy("table").agg(F.count("*").alias("n"))

    def doc_versions(self) -> DataFrame:
        return self.read("pages").where("doc_version is not null").select("doc_version").distinct().orderBy("doc_version")

    def snapshot_page_list(self, snapshot_id: str) -> DataFrame:
        """The pages of a snapshot as they stand now, in order of address."""
        members = self.read("snapshot_pages").where(F.col("snapshot_id") == snapshot_id).select("page_id", F.col("content_hash").alias("captured_hash"))
        return self.read("pages").join(members, "page_id").orderBy("url")


def source_key(url):
    return F.concat(F.lit("src_"), short_id(url))


def page_key(source_id, url):
    return F.concat(F.lit("page_"), short_id(source_id, url))
