"""A corpus pipeline of five operators: filter twice, keep one of near copies, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``. Of an empty table every stage returns an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.llm import decision_rules, packing, quality_lm, shingle_join, substring_dedup
from coderill.llm.queries import vocabulary
from coderill.llm.tables import read, stage_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's bound.

    Null and empty texts and null ids stay; rows stay as often as they come. Without labels all stay.
    """
    return quality_lm.fit(docs, read(spark, sf_dir, "labels")).accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list; null and empty texts have no words and go.

    Rows stay as often as they come, null ids too. Without labels the base rule decides alone.
    """
    rules = decision_rules.fit(docs, read(spark, sf_dir, "labels"))
    return decision_rules.accepted(docs, rules)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id. Rows without an id stay.

    Null and empty texts are copies of nothing; repeated rows of an id that stays all stay.
    """
    groups = shingle_join.join(docs)
    copies = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("__copy")).distinct()
    few = copies.count() <= substring_dedup.BROADCAST_ROWS
    kept = docs.join(F.broadcast(copies) if few else copies, F.col("doc_id") == F.col("__copy"), "left_anti")
    return kept.select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that one of a smaller id has; those left without a word go.

    Null and empty texts and null ids stay as they are; repeated rows of an id are cut alike.
    """
    return substring_dedup.cut(docs, substring_dedup.passages(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence that each is packed into; a null or empty text is a piece of one token."""
    return packing.pack(packing.tokenise(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", passage_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and cut by learned bounds, so SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in a folder that executors share."""
    docs, folder = read(spark, sf_dir, "documents"), stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
