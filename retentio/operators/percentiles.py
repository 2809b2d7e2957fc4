"""Exact ``PERCENTILE_CONT`` (linear interpolation) by distributed selection.

Spark's exact ``percentile`` merges one value→count map per group in a
single task; with a high-cardinality column that map is unbounded.  Here the
rows are reduced to (group, value, count) with a map-side combine, running
counts come from ``ordering.running_totals`` (no single-partition exchange),
and each requested quantile picks the two neighbouring order statistics:

    h = (n − 1)·p,  lo = x[floor(h)],  hi = x[ceil(h)],  q = lo + (h − floor h)(hi − lo)

``p`` is held as a fraction a/b so that ``h``'s integer and fractional parts
are exact; callers receive ``lo``, ``hi``, and the fraction ``f / b`` and
finish with exact arithmetic (see ``value_exact`` / ``round_half_up_units``).
Values must be integers (cents, months); scale them before calling.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_units
from .ordering import running_totals


def as_fraction(p: float | Fraction) -> Fraction:
    return Fraction(p).limit_denominator(1_000_000)


def order_statistics(df: DataFrame, value_col: str, probs: dict[str, float],
                     group_by: Sequence[str] = (), moments: bool = False) -> DataFrame:
    """One row per group with, for each quantile ``name``: ``name_lo``, ``name_hi``,
    ``name_f``, ``name_b`` (fraction f/b of the way from lo to hi) and the group's
    non-null count ``n``.  With ``moments``, also the exact ``sum``, ``sum_sq``,
    ``min`` and ``max`` of the values, taken from the same (value, count) table."""
    return order_statistics_of(value_table(df, value_col, group_by), value_col, probs, group_by, moments)


def value_table(df: DataFrame, value_col: str, group_by: Sequence[str] = ()) -> DataFrame:
    """(group, value) with its count ``_cnt``, the running count ``_cum`` and the group's ``_cum_total``."""
    values = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_by, value_col)
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    return running_totals(values, [F.col(value_col).asc()], {"_cum": "_cnt"}, group_by)


def order_statistics_of(cum: DataFrame, value_col: str, probs: dict[str, float],
                        group_by: Sequence[str] = (), moments: bool = False) -> DataFrame:
    """``order_statistics`` of a ``value_table``."""
    n = F.col("_cum_total")
    start = F.col("_cum") - F.col("_cnt")  # 0-based index of this value's first copy
    end = F.col("_cum")  # exclusive
    aggs = [F.max(n).alias("n")]
    if moments:
        v = F.col(value_col).cast("decimal(38,0)")
        aggs += [
            F.sum(v * F.col("_cnt")).alias("sum"),
            F.sum(v * v * F.col("_cnt")).alias("sum_sq"),
            F.min(value_col).alias("min"),
            F.max(value_col).alias("max"),
        ]
    for name, p in probs.items():
        fr = as_fraction(p)
        a, b = fr.numerator, fr.denominator
        # positions are row counts: bigint arithmetic is exact (evaluated per distinct value)
        scaled = (n - 1) * F.lit(a)
        f = F.pmod(scaled, F.lit(b))
        lo_idx = ((scaled - f) / F.lit(b)).cast("bigint")
        hi_idx = F.when(f > 0, lo_idx + 1).otherwise(lo_idx)
        aggs += [
            F.max(F.when((start <= lo_idx) & (lo_idx < end), F.col(value_col))).alias(f"{name}_lo"),
            F.max(F.when((start <= hi_idx) & (hi_idx < end), F.col(value_col))).alias(f"{name}_hi"),
            F.max(f).cast("bigint").alias(f"{name}_f"),
            F.lit(b).cast("bigint").alias(f"{name}_b"),
        ]
    return cum.groupBy(*group_by).agg(*aggs)


def round_half_up_units(name: str) -> Column:
    """Quantile rounded half-up to the value's integer unit (e.g. whole cents)."""
    lo, hi, f, b = (F.col(f"{name}_{s}") for s in ("lo", "hi", "f", "b"))
    return lo + round_units(f * (hi - lo), b, 1)


def value_exact(name: str, divisor: int = 1) -> Column:
    """Quantile as DOUBLE: (lo·b + f·(hi − lo)) / (b·divisor), one correctly rounded
    division of two exact integers (divisor 100 turns cents into dollars)."""
    lo, hi, f, b = (F.col(f"{name}_{s}") for s in ("lo", "hi", "f", "b"))
    num = (lo * b + f * (hi - lo)).cast("double")
    return num / (b * F.lit(divisor)).cast("double")
