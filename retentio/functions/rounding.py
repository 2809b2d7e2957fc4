"""Exact half-up rounding of ratios, as PostgreSQL ``ROUND(numeric, s)`` does.

Spark's ``avg(decimal)`` keeps 6 fraction digits and a later ``round`` of
that can land 0.01 off at exact ties; double arithmetic differs between
engines in the last bit.  The analyses therefore carry money as integer
cents and counts as integers, and round a ratio ``num / den`` with integer
arithmetic only:

    round_half_up(num * mult / den) = (2 * num * mult + den) div (2 * den)

for ``num >= 0`` and ``den > 0``.  The integer work is done in
``decimal(38,0)`` so sums over a very large fact cannot overflow ``bigint``.
Results leave as DOUBLE, the one numeric type every consumer agrees on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def idiv(a: Column, b: Column) -> Column:
    """Floor division of non-negative integers, exact (no double rounding)."""
    a = a.cast(_WIDE)
    b = b.cast(_WIDE)
    return ((a - F.pmod(a, b)) / b).cast(_WIDE)


def round_units(num: Column, den: Column, mult: int = 1) -> Column:
    """``round_half_up(num * mult / den)`` as an exact integer; NULL when den is 0/NULL."""
    n = num.cast(_WIDE)
    d = den.cast(_WIDE)
    t = n * F.lit(2 * mult) + d
    q = idiv(t, d * F.lit(2))
    return F.when(d > 0, q)


def scaled(units: Column, scale: int) -> Column:
    """Integer units → DOUBLE with ``scale`` fraction digits (units / 10**scale)."""
    return units.cast("double") / F.lit(float(10**scale))


def ratio(num: Column, den: Column, scale: int, mult: int = 1) -> Column:
    """``ROUND(num * mult / den, scale)`` for non-negative integer inputs, as DOUBLE."""
    return scaled(round_units(num, den, mult * 10**scale), scale)


def pct(part: Column, whole: Column, scale: int = 2) -> Column:
    """``ROUND(part * 100.0 / whole, scale)`` exactly."""
    return ratio(part, whole, scale, mult=100)


def pct_units(part: Column, whole: Column) -> Column:
    """Percent with 2 decimals as integer hundredths (for later exact subtraction)."""
    return round_units(part, whole, 10000)


def cents(amount: Column) -> Column:
    """A decimal(…,2) money column as exact integer cents."""
    return (amount * F.lit(100)).cast("bigint")


def money(cents_col: Column) -> Column:
    """Integer cents → DOUBLE dollars."""
    return scaled(cents_col, 2)


def avg_money(sum_cents: Column, n: Column) -> Column:
    """``ROUND(AVG(amount), 2)`` from a cent sum and a count."""
    return scaled(round_units(sum_cents, n, 1), 2)
