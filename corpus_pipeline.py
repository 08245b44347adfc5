"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covelight.llm import decontaminate, language_id, ngram_join, piece_codec, secret_scan
from covelight.llm.common import ensure_checkpoint_dir, small_batches, table
from covelight.llm.queries import MODEL_FILE


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (a null text too) or of no sure language go; rows without a lang are judged by text alone."""
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs), min_score=0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, directly or through others, the least doc_id stays.

    A document without words has no copy and stays; so does a null doc_id.
    """
    small_batches(spark)
    return ngram_join.keep_one(docs, k=5, threshold=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage close to a benchmark item go; a null text holds none, items without an id count too."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    small_batches(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again (null for a null text)."""
    small_batches(spark)
    coded = piece_codec.encode(docs, MODEL_FILE, check_col="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("piece_codec", token_ids),
]
#: The classifier and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
