"""Queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, lines, lm, media, mixing, neardup, packing, quality, repeats, topk
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is searched among all; distances are rounded to six digits, for comparison with SQL."""
    found = topk.nearest(table(spark, sf_dir, "embeddings"), asked="vec_id % 50 = 0")
    return found.withColumn("distance", F.round("distance", 6))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op6_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media, so each page is pictured from all its words first."""
    pages = table(spark, sf_dir, "pages")
    return media.copied_images(pages.select(F.col("page_id").alias("id"), media.thumbnail(F.col("html")).alias("image")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_exact_topk": op4_exact_topk,
    "op5_line_dedup": op5_line_dedup,
    "op6_target_mixing": op6_target_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_media_copies": op9_media_copies,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SQL: dict[str, str] = {
    "op4_exact_topk": """
        WITH pairs AS (
            SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS r FROM pairs
        )
        SELECT vec_id, r::INTEGER AS rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE r <= 10
    """,
    "op5_line_dedup": """
        WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
        lines AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM cut),
        firsts AS (SELECT t, length(t) AS n, min((doc_id, place)) AS born FROM lines WHERE t <> '' GROUP BY t),
        halves AS (SELECT t, n, born, unnest([left(t, n // 2) || chr(10), chr(10) || right(t, n // 2), left(t, (n - 1) // 2) || chr(10), chr(10) || right(t, (n - 1) // 2)]) AS half
                   FROM firsts WHERE n >= 12),
        pairs AS (SELECT DISTINCT a.t AS x, b.t AS y FROM halves a JOIN halves b USING (half) WHERE b.born < a.born AND abs(a.n - b.n) <= 1),
        gone AS (SELECT DISTINCT x FROM (SELECT x, y, unnest(range(0, length(x) + 1)) AS i FROM pairs)
                 WHERE left(x, i) = left(y, i) AND (substr(x, i + 2) = substr(y, i + 2) OR substr(x, i + 1) = substr(y, i + 2) OR substr(x, i + 2) = substr(y, i + 1))),
        marked AS (SELECT l.*, l.t = '' OR (f.born = (l.doc_id, l.place) AND g.x IS NULL) AS kept FROM lines l LEFT JOIN firsts f ON l.t = f.t LEFT JOIN gone g ON l.t = g.x),
        joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (kept), '') AS new, bool_or(t <> '' AND kept) AS any_kept, bool_or(t <> '') AS solid
                   FROM marked GROUP BY doc_id)
        SELECT doc_id, new AS text, lang, source, CASE WHEN new = text THEN n_chars ELSE length(new) END AS n_chars
        FROM documents JOIN joined USING (doc_id) WHERE any_kept OR NOT solid
    """,
    "op10_suffix_array_dedup": """
        WITH split AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM starts),
        shared AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
        hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM windows WHERE w IN (SELECT w FROM shared)),
        islands AS (SELECT doc_id, i, count(*) FILTER (step IS NULL OR step > 50) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM hits)
        SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 50 AS words FROM islands GROUP BY doc_id, island
    """,
}
