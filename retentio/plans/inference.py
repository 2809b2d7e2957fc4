"""Types of text columns, from their values.

Every value has a kind; the kinds of a column join in a lattice:

    missing < boolean < text,   missing < integer < decimal(p, s) < double < text

A boolean and a number join to text.  The join is kept as a set of kinds and
three maxima (digits before the point, digits behind it, characters), so it is
associative and commutative: one aggregation, combined map-side, types all
columns of a table at once, and the rows of two loads merge the same way.

Kinds are told by patterns, which only values that start like a number meet,
so a text costs one look at its first character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: texts read as truth values, and bits of the kinds
TRUTH_VALUES = ["True", "TRUE", "true", "False", "FALSE", "false"]
BOOLEAN, INTEGER, DECIMAL, DOUBLE, TEXT = 1, 2, 4, 8, 16
#: a whole number; one with a point; one with an exponent or not finite (\z: a line break at the end belongs to the value)
WHOLE = r"^[+-]?[0-9]+\z"
POINT = r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)\z"
SCIENTIFIC = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)[eE][+-]?[0-9]+\z|^[+-]?([iI]nf|[iI]nfinity)\z"
WHITESPACE = " \t\n\x0b\x0c\r"
#: digits that a decimal column holds; numbers with more are doubles
MAX_DIGITS = 38


def _kind(value: Column, start: Column) -> Column:
    """Kind of a value without blanks around it, whose first character is ``start``.

    A value that starts like no number meets no pattern unless it starts like
    'inf'.  Each pattern is one pass over the value; a character-wise
    ``translate`` costs tens of times as much.
    """
    number = (F.when(value.rlike(WHOLE), INTEGER).when(value.rlike(POINT), DECIMAL)
              .when(value.rlike(SCIENTIFIC), DOUBLE).otherwise(TEXT))
    return (F.when(start.between("+", "9"), number).when(value.isin(TRUTH_VALUES), BOOLEAN)
            .when(start.isin("i", "I") & value.rlike(SCIENTIFIC), DOUBLE).otherwise(TEXT))


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: n_values, missing_count, width, kinds, before and behind (the lattice's element)."""
    cols = list(columns) if columns else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not cols:
        raise ValueError("no text columns")
    long = df.select(*cols).unpivot([], cols, "column_name", "value")
    # one step a projection, so that each is computed once a value
    trimmed = long.withColumn("_t", F.trim("value", F.lit(WHITESPACE)))
    kinds = trimmed.withColumn("_kind", F.when(F.col("value").isNotNull(), _kind(F.col("_t"), F.substring("_t", 1, 1))))
    before = F.length(F.ltrim(F.substring_index("_t", ".", 1), F.lit("+-0")))  # without sign and leading zeros
    behind = F.length(F.substring_index("_t", ".", -1))
    return merge_kinds(kinds.select(
        "column_name", F.lit(1).cast("bigint").alias("n_values"), F.col("value").isNull().cast("bigint").alias("missing_count"),
        F.length("value").cast("bigint").alias("width"), F.col("_kind").cast("int").alias("kinds"),
        F.when(F.col("_kind").isin(INTEGER, DECIMAL), before).when(F.col("value").isNotNull(), 0).alias("before"),
        F.when(F.col("_kind") == DECIMAL, behind).when(F.col("value").isNotNull(), 0).alias("behind")))


def merge_kinds(elements: DataFrame) -> DataFrame:
    """The join of all elements of a column."""
    return elements.groupBy("column_name").agg(
        F.sum("n_values").alias("n_values"), F.sum("missing_count").alias("missing_count"),
        F.coalesce(F.max("width"), F.lit(0).cast("bigint")).alias("width"), F.coalesce(F.bit_or("kinds"), F.lit(0)).alias("kinds"),
        F.coalesce(F.max("before"), F.lit(0)).alias("before"), F.coalesce(F.max("behind"), F.lit(0)).alias("behind"))


def type_name() -> Column:
    """The type of a merged element."""
    kinds, before, behind = F.col("kinds"), F.col("before"), F.col("behind")

    def only(bits: int) -> Column:
        return kinds.bitwiseAND(F.lit(31 - bits)) == 0

    digits = F.greatest(before + behind, F.lit(1))
    decimal = F.concat(F.lit("decimal("), digits.cast("string"), F.lit(","), behind.cast("string"), F.lit(")"))
    return (F.when(kinds == 0, F.lit("missing")).when(kinds == BOOLEAN, F.lit("boolean"))
            .when(only(INTEGER) & (before <= 9), F.lit("int")).when(only(INTEGER) & (before <= 18), F.lit("bigint"))
            .when(only(INTEGER | DECIMAL) & (digits <= MAX_DIGITS), decimal)
            .when(only(INTEGER | DECIMAL | DOUBLE), F.lit("double")).otherwise(F.lit("text")))


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, inferred_type, width (characters of the longest value), missing_count, n_values, digits and scale
    (of numbers written without an exponent)."""
    return column_kinds(df, columns).select(
        "column_name", type_name().alias("inferred_type"), "width", "missing_count", "n_values",
        (F.col("before") + F.col("behind")).cast("bigint").alias("digits"), F.col("behind").cast("bigint").alias("scale"))


def prof_types(types: DataFrame) -> DataFrame:
    """The report: types of ``column_types`` in column order."""
    return types.orderBy("column_name")
