"""The queries of this subpackage: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chain_dedup import fuzzy_passages
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .line_dedup import line_dedup
from .mixing import sample
from .pii import find_pii
from .quality import score_documents
from .simhash import near_duplicates
from .suffix_dedup import repeated_passages
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with their scores."""
    scores = score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.where("accepted").select("doc_id", "n_passages", "quality_score", "toxic_score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(_table(spark, sf_dir, "documents")).select("doc_id", "source", "docs", "tokens", "rate")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every test item that it leaks."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("key")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a document that is covered by repeated passages of 50 words."""
    return repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy with the document of its group that stays, and its number of links."""
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "kept_id", "links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to every one whose id is divisible by 100."""
    return top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_classifier, op2_html_extraction, op3_source_mixing, op4_pii, op5_decontamination,
    op6_suffix_array_dedup, op7_simhash_near_dedup, op8_line_dedup, op9_exact_top_k, op10_substring_dedup,
)}

ORACLES: dict[str, str] = {
    "op6_suffix_array_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS w FROM documents
        ), passages AS (
            SELECT doc_id, unnest(range(0, len(w) - 49)) AS s, unnest(list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(w[i + 1:i + 50], ' ')))) AS h
            FROM words WHERE len(w) >= 50
        ), again AS (
            SELECT doc_id, s FROM passages QUALIFY count(*) OVER (PARTITION BY h) > 1
        ), marked AS (
            SELECT doc_id, s, CASE WHEN lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 >= s THEN 0 ELSE 1 END AS opens FROM again
        ), islands AS (
            SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked
        )
        SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word FROM islands GROUP BY doc_id, island
    """,
    "op9_exact_top_k": """
        WITH pairs AS (
            SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
            FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM pairs
        )
        SELECT vec_id, rank, neighbor_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 10
    """,
    "op8_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents
        ), full_lines AS (
            SELECT doc_id, p, trim(line) AS a, lead(trim(line)) OVER w AS b, lead(trim(line), 2) OVER w AS c, lead(p) OVER w AS p1, lead(p, 2) OVER w AS p2
            FROM lines WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)
        ), later AS (
            SELECT * FROM full_lines WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) > 1
        ), gone AS (
            SELECT doc_id, p FROM later UNION SELECT doc_id, p1 FROM later UNION SELECT doc_id, p2 FROM later
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        ), counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n, 0) AS n_removed
        FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts USING (doc_id)
    """,
}
