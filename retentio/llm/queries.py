"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (
    byte_bpe, exact_dedup, jaccard, language_id, lexical_search, licences, lm_score, merkle, packing, pii, quality,
    substring_dedup, token_counts)
from .common import documents, frozen


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(*lists):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")

    return licences.licence_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        joined("places.label").alias("base_labels"), joined("places.label", "spans.label").alias("labels"), "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.document_pieces(documents(spark, sf_dir))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit_decreasing(frozen(digests)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pii.KINDS[:4]
    return pii.personal_data(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(pii.KINDS).alias("spans"),
        F.size("id").cast("long").alias("n_id"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_sample(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(documents(spark, sf_dir), trusted)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    operators = (
        op1_token_counts, op2_licence_scans, op3_exact_dedup, op4_best_fit_packing, op5_personal_data, op6_byte_bpe,
        op7_lm_scoring, op8_quality_rules, op9_language_id, op10_ngram_jaccard_join,
        op11_substring_dedup, op12_ranked_search, op13_merkle_manifest)
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op10_ngram_jaccard_join": jaccard.ORACLE,
            "op11_substring_dedup": substring_dedup.ORACLE,
            "op12_ranked_search": lexical_search.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
