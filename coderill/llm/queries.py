"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coderill.llm import bpe, decision_rules, deleted_interpolation, embedding_dedup, embedding_whitening, html_templates, license_scan, packing, quality_lm, shingle_join, source_divergence, substring_dedup, suffix_dedup
from coderill.llm.tables import read


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine with the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(read(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(read(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_lm.judge(docs, quality_lm.fit(docs, read(spark, sf_dir, "labels")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decision_rules.judge(docs, decision_rules.fit(docs, read(spark, sf_dir, "labels")))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_source_divergence": op13_source_divergence,
}

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS k FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = p.i JOIN n b ON b.doc_id = p.j WHERE 100 * c >= 75 * (a.k + b.k - c)),
links AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, links.j FROM reach r JOIN links ON links.i = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT n.doc_id, n.k AS n_shingles, least.component_id FROM n JOIN least ON least.x = n.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op6_license_scan": license_scan.scan_sql(),
    "op13_source_divergence": source_divergence.audit_sql(),
}
