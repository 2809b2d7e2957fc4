"""Exact duplicates by 128-bit content hash, built of DataFrame functions only.

Rows are grouped by the MD5 of the normalised text *and* by the text itself:
the grouping compares bytes, so two texts that merely share a hash form two
classes.  The copies of a text in one partition are combined before the
shuffle, so a group with a third of all rows sends one row per partition.
Documents then find their class by hash alone, without moving texts again; the
(practically empty) set of hashes with several classes goes by hash and text.

Null text counts as empty; all empty texts are one group.  Rows that repeat a
doc_id with the same text are all kept; a null doc_id is never a group's
keeper unless the group has no other.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, frozen, text_or_empty


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text's bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_duplicates(docs: DataFrame, keep: str = "largest", hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the row with the largest or the smallest doc_id of
    equal texts stays; ``hash_of`` maps the normalised text to the group key.
    """
    stays = F.max if keep == "largest" else F.min
    norm = ascii_lower(text_or_empty("text"))
    keyed = docs.select("doc_id", norm.alias("norm")).withColumn("h", hash_of(F.col("norm")))
    classes = keyed.groupBy("h", "norm").agg(stays("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_hash = frozen(classes.groupBy("h").agg(
        F.count("*").alias("classes"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    result = (keyed.select("doc_id", "h", sha)
              .join(by_hash.where("classes = 1"), "h")
              .select("doc_id", "keep_id", "group_size", "text_sha256"))
    collided = by_hash.where("classes > 1").select("h")
    if not collided.isEmpty():
        apart = keyed.join(collided, "h", "left_semi")
        exact = apart.groupBy("h", "norm").agg(stays("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        result = result.unionByName(apart.join(exact, ["h", "norm"])
                                    .select("doc_id", "keep_id", "group_size", sha))
    return result.select("doc_id", "keep_id", "group_size",
                         F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
