from __future__ import annotations

import pytest

LETTERS = "abcdefghij"

#: nulls, empty and odd texts, repeated rows, ties, white space of every kind
TEXTS = [
    None, "", " ", "\n\n", "a", "A b C d E", "the cat sat on the mat", "The CAT sat on the mat",
    "the cat sat on the mat", "Größe ÄÖÜ\tİstanbul Σας 漢字 😀", "x" * 70_000, "ab " * 9_000,
    "one  two\n\n three\r\n\x0bfour\x1cfive\x85six\xa0seven", "<|endoftext|> and <|startoftext|>x",
    "Licensed under CC BY-NC 4.0.\nAll rights reserved. Released under the MIT License.",
    "mail joe@example.com or +1 (684) 555-0954, card 4425 4142-59157784, ip 10.0.0.255 and 1.2.3.456",
    "#a $b %c &d |e <f> *g\nline\nline\n\nline", "w1 w2 w3 w4 w5 w6 " * 40, "0 1 2 3 4 5 6 7 8 9 10 11",
]


def frame(spark, rows=None, extra=True):
    """Rows (doc_id, text) as a table with columns whose names clash with those operators make."""
    rows = list(enumerate(TEXTS)) if rows is None else rows
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    if extra:
        for name in ("norm", "h", "words", "length", "bin", "shard", "n_tokens", "keep_id", "ids", "kind", "start",
                     "lang", "source", "n_chars", "component_id", "component", "a", "b"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture
def docs(spark):
    return frame(spark)


@pytest.fixture
def no_docs(spark):
    return frame(spark, [])


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
