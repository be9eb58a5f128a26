"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.

Defined cases, by stage: a null or wordless text is rejected by the quality rules, so later
stages meet only texts with words, or, cut line by line, empty ones; an emptied text is no
copy of anything, holds no benchmark window and is packed as its end token. Repeated rows
are judged alike, each for itself, and stay or go together; of near copies the smallest id
stays. A null id is never cut or dropped as a copy. Texts of any length are read whole.
Extra columns stay as they are up to packing, whatever their names. Without labels the base
rules alone decide; without benchmark items nothing is contaminated; without documents every
stage is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import stored, table
from corpuslens.llm.decontaminate import drop_contaminated
from corpuslens.llm.line_dedup import dedup_lines
from corpuslens.llm.near_dup import keep_one
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, percent=80, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The hashed model, the sketches and the tokenizer are beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
