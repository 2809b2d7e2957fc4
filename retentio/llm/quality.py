"""Quality rules and a hashed n-gram log-likelihood ratio, built of DataFrame
functions only.

Per document: word, symbol, repeated-line and repeated-window counts, and the
mean over its n-grams of log P(bucket | trusted) - log P(bucket | corpus).
An n-gram is the last ``SUFFIX`` characters of a word, or of two neighbouring
words; it falls into one of ``BUCKETS`` buckets by xxhash64.  The corpus
multinomial counts every n-gram of every document; the trusted one counts
those of labelled good documents, at most ``TRUSTED_ROWS`` of them.  Ratios
are whole micro-nats and their sums are longs, so the verdict does not depend
on the order of rows.  A document is kept when its mean is at least
``threshold`` and the base rules hold.

Windows are compared by the 64-bit hash of their five words.  Null or empty
text: all counts 0, base_failed, not kept.  Without any trusted document every
ratio is 0.  An empty table gives an empty result; columns of the input other
than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BUCKETS = 1 << 13
SUFFIX = 3
TRUSTED_ROWS = 20_000
#: n-grams' worth of corpus distribution that the trusted counts are smoothed with
PRIOR = 1024
#: nats per n-gram, see README for the measured distributions
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_MICRO = 1_000_000


def words_of(text) -> F.Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def _ngrams(words: DataFrame) -> DataFrame:
    """Adds ``grams``: the bucket of each word's end, then of each neighbouring pair of ends."""
    tails = words.withColumn("tails", F.transform("words", lambda w: F.xxhash64(F.right(w, F.lit(SUFFIX)))))
    one = F.transform("tails", lambda t: F.pmod(t, F.lit(BUCKETS)).cast("int"))
    two = F.expr("zip_with(slice(tails, 1, greatest(size(tails) - 1, 0)), slice(tails, 2, greatest(size(tails) - 1, 0)), "
                 f"(a, b) -> cast(pmod(shiftrightunsigned(a, 7) ^ b, {BUCKETS}) as int))")
    return tails.withColumn("grams", F.concat(one, two)).drop("tails")


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of at most ``rows`` documents labelled good, the smallest by hash."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Micro-nats by bucket.  All n-grams of all documents are counted; at most
    BUCKETS counts come to the driver.  ``trusted`` has at most TRUSTED_ROWS ids."""
    marked = (docs.select("doc_id", words_of(text_or_empty("text")).alias("words"))
              .join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left"))
    counts = (_ngrams(marked).select(F.explode_outer("grams").alias("bucket"), "trusted").where("bucket IS NOT NULL")
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good")).collect())
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    if not sum(good):
        return [0] * BUCKETS
    n_raw, n_good = sum(raw) + BUCKETS, sum(good) + PRIOR
    return [round(_MICRO * math.log((g + PRIOR * (c + 1) / n_raw) / n_good * n_raw / (c + 1))) for c, g in zip(raw, good)]


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, llr (mean nats per n-gram, null
    without words) and kept."""
    ratios = F.from_json(F.lit(str(log_ratios(docs, trusted))), "array<int>")
    text = text_or_empty("text")
    base = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"))
    counted = _ngrams(base).select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike("[#*$%&|<>]"), F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, "")))
        .otherwise(0).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> length(btrim(l, ' \t\u000b\u000c\r')) > 0)").alias("lines"),
        F.size("grams").cast("long").alias("n_grams"),
        F.aggregate("grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get(ratios, g)).alias("micro"))
    # the hash of a five-word window is put together of those of its words, pairs and fours
    windows = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "micro", "n_grams",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ones"))
    for joined, left, right, step in (("twos", "ones", "ones", 1), ("fours", "twos", "twos", 2), ("grams5", "fours", "ones", 4)):
        windows = windows.withColumn(joined, F.expr(
            f"zip_with(slice({left}, 1, greatest(size({right}) - {step}, 0)), "
            f"slice({right}, {step + 1}, greatest(size({right}) - {step}, 0)), (a, b) -> xxhash64(a, b))"))
    windows = windows.drop("ones", "twos", "fours")
    # positions of windows found again: sorted by hash, a repeat stands beside its like
    ordered = windows.withColumn("sorted", F.expr(
        "if(size(array_distinct(grams5)) < size(grams5), "
        "sort_array(transform(grams5, (h, i) -> struct(h as h, i as i))), "
        "cast(array() as array<struct<h: bigint, i: int>>))")).drop("grams5")
    found = ordered.withColumn("at", F.expr(
        "sort_array(transform(filter(sorted, (x, j) -> get(sorted, j - 1).h = x.h OR get(sorted, j + 1).h = x.h), x -> x.i))")
    ).drop("sorted")
    # a window covers five words, or as many as lie before the next window found
    repeats = F.expr("if(size(at) = 0, 0L, 5L + aggregate(zip_with(slice(at, 1, greatest(size(at) - 1, 0)), "
                     "slice(at, 2, greatest(size(at) - 1, 0)), (a, b) -> cast(least(b - a, 5) as bigint)), "
                     "0L, (s, x) -> s + x))")
    judged = found.withColumn("n_repeat_words", repeats).withColumn(
        "base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("micro") / F.nullif("n_grams", F.lit(0)) / _MICRO).alias("llr"),
        (~F.col("base_failed") & (F.col("micro") >= F.lit(round(threshold * _MICRO)) * F.col("n_grams"))).alias("kept"))
