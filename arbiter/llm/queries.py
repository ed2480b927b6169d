"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, epsilon_join, exact_dedup, html_template, license_scan, matroska, ngram_join, packing, suffix_dedup, token_alignment, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digests(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op7_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(_table(spark, sf_dir, "documents"))


def op12_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(_table(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (op1_ngram_join, op2_url_filter, op3_byte_bpe, op4_suffix_dedup, op5_license_scan, op6_matroska, op7_html_template, op8_best_fit_packing, op9_exact_dedup, op10_toxicity, op11_token_alignment, op12_epsilon_join, op13_vector_codes)}
ORACLE = {"op1_ngram_join": ngram_join.ORACLE, "op2_url_filter": url_filter.ORACLE, "op5_license_scan": license_scan.oracle(), "op9_exact_dedup": exact_dedup.ORACLE, "op12_epsilon_join": epsilon_join.ORACLE, "op13_vector_codes": vector_codes.oracle()}
