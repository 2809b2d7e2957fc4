"""CSV landing files → raw table.

The raw layer keeps every value as text: the reader is told nothing about
types (no inference pass over the data), header names are normalised to
lower case with ``_`` for spaces, and the tokens pandas would read as missing
become NULL.  Blank strings such as ``' '`` are kept — cleaning them is the
staging layer's job.  Quotes inside a quoted field are doubled, a backslash is
an ordinary character and a field may hold line breaks, as in RFC 4180; files
are read in parallel all the same (``csv_records``).  The load replaces the target (overwrite), which is the file-system form
of truncate-and-insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.profile import PANDAS_NA_TOKENS
from .csv_records import DIALECT, read_csv_text


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str, na_tokens: list[str] | None = None) -> DataFrame:
    tokens = PANDAS_NA_TOKENS if na_tokens is None else na_tokens
    df = normalise_names(read_csv_text(spark, path))
    return df.select(*[F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c)).alias(c) for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Inspection read with type inference (one extra pass over the file)."""
    return spark.read.options(**DIALECT, header="true", multiLine="true", inferSchema="true").csv(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write a landing file the way a source system would (text, header, blanks kept)."""
    df.write.mode("overwrite").options(**DIALECT, header="true").csv(path)


def ing_raw_load(spark: SparkSession, csv_path: str, raw_path: str) -> DataFrame:
    """Load ``csv_path`` into the raw Parquet table at ``raw_path`` (full replace)."""
    read_raw_csv(spark, csv_path).write.mode("overwrite").parquet(raw_path)
    return spark.read.parquet(raw_path)
