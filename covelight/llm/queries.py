"""Queries op1_ to op13_: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, html_extract, language_id, ngram_join, oracles, piece_codec, quality_classifier, quality_rules, secret_scan, substring_dedup, token_shards, url_filter, vector_codes
from .common import table


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents")).select(*quality_rules.DIGEST)


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("COVELIGHT_TOKENIZERS", "/opt/tokenizers")
MODEL_FILE = f"{TOKENIZERS}/piece_bpe_32k.model"


def piece_codec_query(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """Every document encoded and decoded again; the digest of its ids instead of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode(docs, model_file, check_col="round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def html_extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"), k=3, threshold=0.9)


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


WORD_FILE = f"{TOKENIZERS}/word_bpe_49k.json"


def token_shards_query(spark: SparkSession, sf_dir: str, tokenizer_file: str = WORD_FILE) -> DataFrame:
    """All documents written to shard files below the checkpoint folder and read back from them."""
    index = token_shards.write_shards(table(spark, sf_dir, "documents"), token_shards.new_place(spark), tokenizer_file)
    return token_shards.read_documents(index, ids=False)


def conversation_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def vector_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": quality_rules_query,
    "op2_language_id": language_id_query,
    "op3_piece_codec": piece_codec_query,
    "op4_html_extract": html_extract_query,
    "op5_decontaminate": decontaminate_query,
    "op6_url_filter": url_filter_query,
    "op7_ngram_join": ngram_join_query,
    "op8_substring_dedup": substring_dedup_query,
    "op9_quality_classifier": quality_classifier_query,
    "op10_secret_scan": secret_scan_query,
    "op11_token_shards": token_shards_query,
    "op12_conversation_trie": conversation_trie_query,
    "op13_vector_codes": vector_codes_query,
}
ORACLES = {"op1_quality_rules": oracles.QUALITY_RULES, "op7_ngram_join": oracles.NGRAM_JOIN, "op8_substring_dedup": oracles.SUBSTRING_DEDUP, "op12_conversation_trie": oracles.CONVERSATION_TRIE, "op13_vector_codes": oracles.VECTOR_CODES}
