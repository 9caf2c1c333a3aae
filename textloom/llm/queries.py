"""The registered query of each operator: production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embdedup, knn, langid, licenses, mixing, ngramjoin, sharding, substring, warc


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_chunks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_embedding_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_mixtures(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_knn_join": op4_knn_join,
    "op5_warc_chunks": op5_warc_chunks,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_pairs": op7_embedding_near_pairs,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_reshard": op10_reshard,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring.SQL,
    "op4_knn_join": knn.SQL,
    "op5_warc_chunks": warc.SQL,
    "op6_license_scan": licenses.SQL,
    "op7_embedding_near_pairs": embdedup.SQL,
    "op8_ngram_jaccard_join": ngramjoin.SQL,
}
