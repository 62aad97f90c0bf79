"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, piece ids. Each stage is a Spark job over all its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, ngram_join, pieces, pii, quality
from folioforge.llm.common import row_key, settle, shared_folder, table


def accepted_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the ranker rejects go."""
    ranker = quality.train_ranker(docs, table(spark, sf_dir, "labels"), ~quality.in_third(F.col("doc_id"), 1))
    return quality.score_quality(docs, ranker).where("_predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of documents that link (five words, similarity 0.8), the one with the smallest doc_id stays, ids before none.

    Rows are nodes by id and text: each text of a shared id links on its own, and so do texts without an id. Rows equal in both are
    one node, of which one row stays.
    """
    keyed = docs.withColumn("_key", row_key())
    nodes = ngram_join.ngram_components(keyed.select(F.col("_key").alias("doc_id"), "text"), size=5, percent=80).groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_group"), F.count(F.lit(1)).alias("_rows"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_rows")).alias("first")
    kept = settle(nodes.join(ids, "_key").groupBy("_group").agg(first).select("first._key", "first._rows"))
    one = keyed.join(kept, "_key")
    if not kept.where("_rows > 1").isEmpty():
        several = one.where("_rows > 1").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
        return one.where("_rows = 1").select(*docs.columns).unionByName(several)
    return one.select(*docs.columns)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data give way to their kinds in brackets."""
    return pii.redact(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: piece ids of each whole text; decoded again, they must give the text."""
    return pieces.piece_counts(docs)


STAGES = [
    ("quality classifier", accepted_by_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece", as_pieces),
]

#: SQL can't express a learned ranking or the walks; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
