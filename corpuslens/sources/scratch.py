"""Tables written midway, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes of compressed files for each part of a table that is dealt out.
DEALT_BYTES = 8_000_000


@cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpuslens-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, whose driver and executors are one process, may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local()
    return base.rstrip("/")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as Parquet, read back: what comes after reads it as often as it likes, and a lost executor
    costs a re-read only. The folder goes when the session ends. Of large rows a file should hold
    few, `rows` at most: Spark's reader takes 4,096 rows of a file at once, whatever their size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-{uuid.uuid4().hex}/{name}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder.getParent())
    df.write.option("maxRecordsPerFile", rows or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of fewer files than there are cores are dealt out by key before work that takes many
    times a scan's time (one file of one row group is one task, whatever the split size). Where
    there are files enough, the scan is left as it is and nothing is shuffled. Parts hold about
    DEALT_BYTES of the files, so that what a task sorts or holds does not grow with the table."""
    context = df.sparkSession.sparkContext
    cores, files = context.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    paths = [context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI.create(f)) for f in files]
    size = sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(max(cores, -(-size // DEALT_BYTES)), key)
