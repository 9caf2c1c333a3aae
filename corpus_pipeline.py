"""The corpus pipeline: documents to token ids, in stages that are each written and read again.

Language identification drops documents without an identifiable language, the n-gram Jaccard join keeps one document
of each group of near copies, substring dedup removes repeated passages (a document of which nothing is left goes),
mixing draws blocks from the sources at their target weights, and BPE encodes what was drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, langid, mixing, ngramjoin, substring
from textloom.llm.common import WORD, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; documents that lost all their words go, those without any before stay."""
    out = substring.substring_dedup(docs, removed="__removed")
    out = out.where((F.col("__removed") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__removed")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token ids, and whether they decode to the text."""
    ids = docs.select("doc_id", "source", "lang", bpe.encode_checked(spark, F.col("text")).alias("__r"))
    return ids.select("doc_id", "source", "lang", F.size("__r.token_ids").alias("n_tokens"), "__r.token_ids", "__r.round_trip")


STAGES = [("language_id", language_id), ("ngram_jaccard_dedup", ngram_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix), ("bpe_encode", encode)]

#: SQL can't express the mixtures, the draws or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
