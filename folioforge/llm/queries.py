"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import exact_copies, hard_negatives, prefix_trie, secret_scan
from folioforge.llm.common import table
from folioforge.llm.decontaminate import find_leaks
from folioforge.llm.language import language_scores
from folioforge.llm.neighbours import nearest
from folioforge.llm.ngram_join import ngram_join
from folioforge.llm.pieces import piece_counts
from folioforge.llm.pii import pii_digest
from folioforge.llm.quality import quality_scores
from folioforge.llm.repeats import repeats_digest
from folioforge.llm.wrappers import extract


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.find_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontaminate": op9_decontaminate,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_copies": op13_exact_copies,
}

#: Where SQL can say it; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_secrets": secret_scan.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(),
    "op12_prefix_trie": prefix_trie.oracle_sql(),
    "op13_exact_copies": exact_copies.oracle_sql(),
}
