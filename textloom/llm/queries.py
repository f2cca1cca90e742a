"""The operators' queries, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, html_text, licenses, matroska, mixing, near_dedup, packing, pii, quality, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_table(spark, sf_dir, "documents"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of media: every document is written as a timed-text Matroska file first."""
    return matroska.packets(matroska.as_media(_table(spark, sf_dir, "documents")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.links(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_pii, op3_exact_dedup, op4_suffix_array, op5_licenses, op6_matroska, op7_html, op8_ngram_jaccard, op9_packing, op10_mixing)}


_EXACT = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, n_rows
FROM (SELECT doc_id, text, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text)
"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS n, doc_id, w FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents)),
s AS (SELECT n, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS grams FROM w WHERE len(w) > 0),
g AS (SELECT n, len(grams) AS size, unnest(grams) AS gram FROM s),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS shared, a.size + b.size AS total FROM g a JOIN g b ON a.gram = b.gram AND a.n <> b.n GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE shared >= 0.5 * (total - shared)),
r(n, m) AS (SELECT n, n FROM w UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT w.doc_id, t.doc_id AS class_id, (SELECT count(*) FROM e WHERE e.a = w.n) AS n_links
FROM w JOIN c ON c.n = w.n JOIN w t ON t.n = c.m
"""

_REPEATS = r"""
WITH w AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, p, sha256(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM x),
o AS (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS is_copy FROM h),
s AS (SELECT doc_id, p, is_copy, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id, is_copy ORDER BY p) + 50 THEN 1 ELSE 0 END AS gap FROM o WHERE c > 1),
g AS (SELECT doc_id, p, is_copy, sum(gap) OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS span FROM s)
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, is_copy FROM g GROUP BY doc_id, is_copy, span
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _EXACT, "op4_suffix_array": _REPEATS, "op8_ngram_jaccard": _JACCARD}
