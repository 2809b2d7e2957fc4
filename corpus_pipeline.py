"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of ``documents``.

* language_id: documents whose language cannot be told go (no letter, or a
  score under ``MIN_SCORE``).
* exact_dedup: of equal texts the row with the largest doc_id stays.
* ngram_jaccard: of documents linked by similarity the smallest doc_id stays.
* personal_data: each span is replaced by its kind in brackets.
* best_fit_packing: pieces of documents with their sequence and place in it.

Rows with a null doc_id pass the two deduplications unless an equal text with
a doc_id stays.  An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import exact_dedup, jaccard, language_id, packing, pii
from retentio.llm.common import ascii_lower, documents, frozen, text_or_empty

#: little over chance among four languages; clean texts of a few words score higher
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs), MIN_SCORE)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_duplicates(docs, keep="largest").where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(text_or_empty(docs["text"])).cast("binary"), 256)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (sha == kept["_sha"]), "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard.similar_documents(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors still hold what earlier stages left, so workers remember less than in a job of its own
    pieces = packing.document_pieces(docs, cached_chunks=150_000)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit_decreasing(frozen(digests)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("ngram_jaccard", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: languages, links and packing by search cannot be told in SQL; tests/llm/test_pipeline.py has the brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
