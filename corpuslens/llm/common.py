"""Helpers shared by the operators of this subpackage: scratch tables in the
cluster's shared folder, and Arrow-batch word columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch sent to Python; whole texts travel, so the default of 10,000 is too many.
BATCH_ROWS = 1000


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of a batch that Python workers hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir). Where the session names none, a
    local master gets a temporary one, as its driver and executors are one process; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_scratch()
    return base.rstrip("/")


@cache
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpuslens-")


def shared_value(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of (token, value). What a worker builds from the value is kept by the
    token: addresses and numbers of broadcasts come again, tokens do not."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


_BUILT: dict[Callable, tuple[str, object]] = {}


def built(shared: Broadcast, build: Callable[[object], object]) -> object:
    """build(value) of shared_value(), made once in a worker process; the last one of each kind is kept."""
    token, value = shared.value
    if _BUILT.get(build, ("", None))[0] != token:
        _BUILT.pop(build, None)
        _BUILT[build] = (token, build(value))
    return _BUILT[build][1]


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends
    there, so a lost executor costs a re-read only. The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path.getParent())
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whitespace_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text of a string array, nulls having none.

    Returns (codes, distinct, offsets): text i has the words
    distinct[codes[offsets[i]:offsets[i+1]]]. All of it runs in Arrow's C++ kernels.
    """
    if texts.offset:  # the ASCII kernels misread slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    enc = flat.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    codes = enc.indices.to_numpy()
    distinct = enc.dictionary
    offsets = (offsets - offsets[0]).astype(np.int64)
    # leading or trailing white space leaves empty strings: drop them
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        codes, offsets = codes[keep], kept_before[offsets]
    return codes, distinct, offsets
