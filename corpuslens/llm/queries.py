"""Queries opN_<name> of this subpackage: each applies its operator, with production
parameters, to the whole table it is meant for, and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=80, shingle=2)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import round_trip

    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text
    from .url_filter import judge_urls, labels_by_text

    pages = table(spark, sf_dir, "pages")
    labelled = labels_by_text(extract_main_text(pages), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_boilerplate

    cut = remove_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("_row.doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import damaged, repair_turns

    repaired = repair_turns(damaged(table(spark, sf_dir, "conversations")), there=F.col("there"))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repaired.select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_near_duplicates, op3_html_text, op4_token_counts, op5_token_files, op6_url_filter, op7_line_dedup, op8_quality, op9_packing, op10_toxicity, op11_turn_repair, op12_exact_dedup, op13_ranked_search)}

_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _SMALL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = "regexp_extract_all(" + _SMALL + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
spots AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT spots.doc_id, spots.i, spots.n, windows.item_id FROM spots JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
texts AS (SELECT text, min(source) AS site, min(doc_id) AS id FROM d WHERE text IS NOT NULL GROUP BY text),
each AS (SELECT DISTINCT id, site, line FROM (SELECT id, site, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bad AS (SELECT line, min(id) AS keeper FROM each GROUP BY line HAVING count(DISTINCT site) >= 10),
parts AS (SELECT r, doc_id, line, i FROM (SELECT r, doc_id, string_split(text, chr(10)) AS l,
  unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d), LATERAL (SELECT l[i] AS line)),
kept AS (SELECT r, string_agg(parts.line, chr(10) ORDER BY i) AS text, count(*) AS n FROM parts LEFT JOIN bad ON parts.line = bad.line
  WHERE bad.line IS NULL OR parts.doc_id = keeper GROUP BY r)
SELECT doc_id, len(string_split(d.text, chr(10))) AS n_lines, len(string_split(d.text, chr(10))) - coalesce(n, 0) AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN kept USING (r)""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
c AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
stats AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term, nd),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term), stats GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0) WHERE r <= 10""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM g""",
}
