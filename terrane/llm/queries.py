"""The queries of this subpackage: each operator with production parameters over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bm25, bpe, decontam, katz, langid, line_dedup, ngram_join, pii, quality, suffix_dedup
from terrane.llm.text import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op2_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), bucket_of(F.col("doc_id"), 7) != 2)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = quality.train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality"))
    return quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card and n_phone count base spans; those that the method adds are in spans and in n_added."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base_spans", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, among all."""
    return bm25.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 100 == 0, k=10)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", "best_share")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_katz_score, op3_suffix_dedup, op4_line_dedup, op5_quality, op6_language_id, op7_pii, op8_byte_bpe, op9_bm25_search, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE, "op9_bm25_search": bm25.ORACLE}
