"""Small SQL text builders shared by the oracle modules."""

from __future__ import annotations

from fractions import Fraction

from .base import scaled, units


def order_stats_cte(name: str, source: str, value: str, probs: dict[str, float], group: list[str] | None = None) -> str:
    """CTE ``name`` with, per group, n and for each quantile q: q_lo, q_hi, q_f, q_b
    (PERCENTILE_CONT neighbours and fraction f/b), over non-null ``value``."""
    g = group or []
    part = f"PARTITION BY {', '.join(g)} " if g else ""
    gsel = "".join(f"{c}, " for c in g)
    cols = []
    for q, p in probs.items():
        fr = Fraction(p).limit_denominator(1_000_000)
        a, b = fr.numerator, fr.denominator
        lo_i = f"((n - 1) * {a}) // {b}"
        f = f"((n - 1) * {a}) % {b}"
        cols += [
            f"max(v) FILTER (WHERE i = {lo_i}) AS {q}_lo",
            f"max(v) FILTER (WHERE i = {lo_i} + CASE WHEN {f} > 0 THEN 1 ELSE 0 END) AS {q}_hi",
            f"max({f}) AS {q}_f",
            f"{b} AS {q}_b",
        ]
    group_by = ", ".join(g + ["n"])
    return (
        f"{name}_ord AS (SELECT {gsel}{value} AS v, row_number() OVER ({part}ORDER BY {value}) - 1 AS i, "
        f"COUNT(*) OVER ({part.strip()}) AS n FROM {source} WHERE {value} IS NOT NULL),\n"
        f"{name} AS (SELECT {gsel}n, {', '.join(cols)} FROM {name}_ord GROUP BY {group_by})"
    )


def q_round_units(q: str) -> str:
    """Quantile rounded half-up to the integer unit."""
    return f"({q}_lo + {units(f'{q}_f * ({q}_hi - {q}_lo)', f'{q}_b', 1)})"


def q_value(q: str, divisor: int = 1) -> str:
    return f"(CAST({q}_lo * {q}_b + {q}_f * ({q}_hi - {q}_lo) AS DOUBLE) / CAST({q}_b * {divisor} AS DOUBLE))"


def q_scaled(q: str, scale: int) -> str:
    return scaled(q_round_units(q), scale)


def row(check: str, subject: str, observed: str, expected: str | None = None) -> str:
    exp = f"CAST({expected} AS DOUBLE)" if expected is not None else "CAST(NULL AS DOUBLE)"
    ok = f"CAST({observed} AS DOUBLE) = CAST({expected} AS DOUBLE)" if expected is not None else "CAST(NULL AS BOOLEAN)"
    return (f"SELECT '{check}' AS \"check\", '{subject}' AS subject, CAST({observed} AS DOUBLE) AS observed, "
            f"{exp} AS expected, {ok} AS ok")
