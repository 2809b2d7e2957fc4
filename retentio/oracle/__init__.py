"""DuckDB oracle SQL, one string per registered query key."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    from . import analytics, eda_stats_dashboard, etl, profile_quality

    out: dict[str, str] = {}
    out.update(etl.oracles())
    out.update(profile_quality.oracles())
    out.update(analytics.oracles())
    out.update(eda_stats_dashboard.oracles())
    out["wh_risk_profile"] = out["q6a_risk_profile"]  # the same report, of the saved tables
    return out
