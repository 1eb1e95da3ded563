"""Queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import byte_bpe, code_compression, embedding_dedup, langid, ngram_join, packing, pii, quality, sql, token_alignment, token_counts, topk_search, toxicity, url_filter
from panelforge.llm.frames import read


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(read(spark, sf_dir, "documents"))
    hashed = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = byte_bpe.decode_ids(hashed, "ids", keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(read(spark, sf_dir, "documents")))


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.product_codes(read(spark, sf_dir, "embeddings"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_products(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_spans,
        op2_quality_rules,
        op3_token_counts,
        op4_byte_bpe,
        op5_toxicity,
        op6_ngram_jaccard,
        op7_url_rules,
        op8_best_fit_packing,
        op9_embedding_duplicates,
        op10_language,
        op11_token_alignment,
        op12_vector_codes,
        op13_top_products,
    )
}

QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {
    "op2_quality_rules": sql.quality_rules(),
    "op7_url_rules": sql.url_rules(),
    "op12_vector_codes": sql.vector_codes(),
    "op13_top_products": sql.top_products(),
}
