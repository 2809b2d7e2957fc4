"""Profiling of the raw (all-string) table.

Each report is one aggregation pass: per-column counts are fused into a
single ``agg`` (one job, not one query per column) and turned into rows with
``unpivot``.  Only aggregates ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import pct, round_units, scaled
from ..operators.joins import broadcast_or_merge
from ..operators.ordering import checkpointed
from ..operators.percentiles import order_statistics
from .inference import column_types

# --- fixed values: strings pandas reads as missing (its default NA tokens)
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _long(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([], list(columns), name, value)


def prof_shape(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(raw.columns)).cast("bigint").alias("n_columns"))


def prof_sample(raw: DataFrame, n: int = 5, key: str = "customerid") -> DataFrame:
    """First ``n`` rows in key order (a deterministic stand-in for 'head')."""
    return raw.orderBy(key).limit(n)


def prof_missing(raw: DataFrame) -> DataFrame:
    """NULL count and % per column, only columns with at least one NULL."""
    cols = raw.columns
    agg = raw.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot(["_n"], cols, "column_name", "missing_count")
    return long.where(F.col("missing_count") > 0).select(
        "column_name", "missing_count", pct(F.col("missing_count"), F.col("_n")).alias("missing_pct")
    )


# Leading/trailing characters str.strip() removes from ASCII text: space, \t, \n, \v, \f, \r.
WHITESPACE = " \t\n\x0b\x0c\r"


def _strip_all(c):
    # a trim with an explicit character set, not a regex (4x cheaper per value)
    return F.trim(c, F.lit(WHITESPACE))


def prof_blank(raw: DataFrame) -> DataFrame:
    """Blank or whitespace-only values per column (only > 0), plus an overall row."""
    cols = raw.columns
    agg = raw.agg(*[F.count_if(_strip_all(F.col(c)) == "").alias(c) for c in cols])
    long = _long(agg, cols, "column_name", "blank_count")
    per_col = long.where(F.col("blank_count") > 0)
    total = long.agg(F.sum("blank_count").alias("blank_count")).select(F.lit("*").alias("column_name"), "blank_count")
    return per_col.unionByName(total)


def row_hash(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row; a null counts by its place."""
    marks = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    cols = [F.col(c) for c in columns]
    return [F.xxhash64(marks, *cols).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cols), marks).alias("_h2")]


def prof_duplicates(raw: DataFrame, key: str = "customerid", hash_of=row_hash) -> DataFrame:
    """Fully duplicated rows and duplicated keys (copies beyond the first; NULLs equal).

    Rows are counted by a 128-bit hash and keys by themselves, both combined
    map-side, so a row or key that is common costs one row per task and no row is
    moved.  Only rows whose hash occurs again are then grouped whole, which tells
    rows that merely share a hash apart.
    """
    hashed = raw.select(*hash_of(raw.columns))
    again = checkpointed(hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if again.isEmpty():
        rows = raw.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicate_rows"))
    else:
        suspects = raw.select("*", *hash_of(raw.columns)).join(broadcast_or_merge(again), ["_h1", "_h2"], "left_semi")
        equal = suspects.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
        rows = equal.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    keys = raw.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint"))
    return rows.select("duplicate_rows", keys.scalar().alias("duplicate_keys"))


def prof_categories(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per string column with their counts (one unpivot + one groupBy)."""
    cols = list(columns) if columns else [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"]
    long = _long(raw.select(*cols), cols, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("value_count")).orderBy(
        "column_name", "value"
    )


NUMERIC_TYPES = ("int", "bigint", "decimal", "double")
#: digits up to which squares of a column are summed exactly (their sums have 38); longer numbers are profiled as doubles
EXACT_DIGITS = 12


def numeric_columns(raw: DataFrame) -> dict[str, int]:
    """Columns every non-missing value of which reads as a number (pandas-like
    inference, ``plans/inference.py``), with the most decimals that any value has."""
    return {r.column_name: r.scale for r in _numeric(raw, column_types(raw))}


def _numeric(raw: DataFrame, types: DataFrame) -> list:
    """The types of the numeric columns: one small row a column, in table order; a column without any value is none."""
    rows = types.where(F.substring_index("inferred_type", "(", 1).isin(*NUMERIC_TYPES)).collect()
    return sorted(rows, key=lambda r: raw.columns.index(r.column_name))


def describe(df: DataFrame, columns: Sequence[str], scale: int = 2, decimals: int | dict[str, int] = 2,
             narrow: bool = False) -> DataFrame:
    """count / mean / std / min / 25% / 50% / 75% / max per column, rounded half-up
    to ``scale`` digits at the end.  Exact: values become integers at ``decimals``
    digits (the most that any has; a number for all or one a column), moments are
    integer sums, quartiles come from ``order_statistics``.  ``narrow``: no integer
    has more than ``EXACT_DIGITS``, so they are grouped, moved and sorted as bigint."""
    inner = {c: max(scale, decimals[c] if isinstance(decimals, dict) else decimals) for c in columns}
    digits, units = (18, "bigint") if narrow else (38, "decimal(38,0)")
    long = _long(
        df.select(*[(F.col(c).cast(f"decimal({digits},{inner[c]})") * 10**inner[c]).cast(units).alias(c) for c in columns]),
        list(columns), "column_name", "_v",
    ).where(F.col("_v").isNotNull())
    # quantiles and exact moments come from one (column, value, count) table
    q = order_statistics(long, "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"], moments=True)
    finer = F.create_map(*[F.lit(x) for c in columns for x in (c, inner[c] - scale)])
    q = q.withColumn("coarser", F.pow(F.lit(10.0), finer[F.col("column_name")]).cast("decimal(38,0)"))
    unit, coarser = F.col("coarser").cast("double") * F.lit(float(10**scale)), F.col("coarser")
    n = F.col("n").cast("decimal(38,0)")
    var_num = n * F.col("sum_sq") - F.col("sum") * F.col("sum")
    sd = F.sqrt(var_num.cast("double") / (n * (n - 1)).cast("double")) / unit

    def quantile(name: str) -> Column:
        lo, hi, f, b = (F.col(f"{name}_{x}") for x in ("lo", "hi", "f", "b"))
        return scaled(round_units(lo * b + f * (hi - lo), b * coarser, 1), scale)

    def whole(name: str) -> Column:
        return scaled(round_units(F.col(name), coarser, 1), scale)

    return q.select(
        "column_name",
        F.col("n").alias("count"),
        scaled(round_units(F.col("sum"), n * coarser, 1), scale).alias("mean"),
        F.round(sd, scale).alias("std"),
        whole("min").alias("min"),
        quantile("p25").alias("p25"),
        quantile("p50").alias("p50"),
        quantile("p75").alias("p75"),
        whole("max").alias("max"),
    ).orderBy("column_name")


def describe_doubles(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    """The same for numbers of any size, in doubles: the mean is taken around the
    median, so a large common part costs no digits, and the variance by merged
    central moments."""
    long = _long(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), list(columns), "column_name", "_v").where(
        F.col("_v").isNotNull())
    q = order_statistics(long, "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"])

    def quantile(name: str) -> Column:
        lo, hi, f, b = (F.col(f"{name}_{x}") for x in ("lo", "hi", "f", "b"))
        return F.when(lo == hi, lo).otherwise(lo + f / b * (hi - lo))

    q = checkpointed(q.select("column_name", "n", *[quantile(p).alias(p) for p in ("p25", "p50", "p75")]))  # a row a column
    moments = (long.join(F.broadcast(q.select("column_name", F.col("p50").alias("_mid"))), "column_name").groupBy("column_name").agg(
        F.first("_mid").alias("_mid"), F.avg(F.col("_v") - F.col("_mid")).alias("_off"), F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("min"), F.max("_v").alias("max")))
    return q.join(F.broadcast(moments), "column_name").select(
        "column_name", F.col("n").alias("count"), F.round(F.col("_mid") + F.col("_off"), scale).alias("mean"),
        F.round("_sd", scale).alias("std"), *[F.round(c, scale).alias(c) for c in ("min", "p25", "p50", "p75", "max")]
    ).orderBy("column_name")


def prof_numeric(raw: DataFrame, columns: Sequence[str] | None = None, types: DataFrame | None = None) -> DataFrame:
    """``describe`` of the numeric columns.  ``types`` are known ``column_types``; without them they cost a pass."""
    chosen = raw.select(*columns) if columns else raw
    types = column_types(chosen) if types is None else types.where(F.col("column_name").isin(chosen.columns))
    exact, wide = {}, []
    for r in _numeric(chosen, types):
        if r.inferred_type != "double" and r.digits - r.scale + max(2, r.scale) <= EXACT_DIGITS:
            exact[r.column_name] = r.scale
        else:
            wide.append(r.column_name)
    parts = ([describe(raw, list(exact), decimals=exact, narrow=True)] if exact or not wide else []) + ([describe_doubles(raw, wide)] if wide else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).orderBy("column_name")


def prof_coerce(raw: DataFrame, column: str = "totalcharges") -> DataFrame:
    """Rows whose ``column`` does not parse as a number (blank included)."""
    return raw.where(F.col(column).try_cast("double").isNull()).select(
        "customerid", "tenure", "monthlycharges", column
    ).orderBy("customerid")


def prof_target(df: DataFrame, target: str = "churn") -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("customer_count"))
    from pyspark.sql import Window

    total = F.sum("customer_count").over(Window.partitionBy())  # over the handful of target values
    return counts.select(target, "customer_count", pct(F.col("customer_count"), total).alias("pct_of_total")).orderBy(target)
