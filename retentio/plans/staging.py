"""Staging layer: typed cleaning of the raw table, and the quarantine of rows
the typed table's constraints would refuse.

``stg_clean`` is one narrow ``select`` (no shuffle).  Casts are strict, as in
the source model: a malformed number aborts the job instead of silently
becoming NULL, whether or not the session runs in ANSI mode.
``check_raw`` marks every raw row with the rules it breaks (``try_cast``, one
grouped count of the ids), so a load is split once: ``accepted`` rows go to
``stg_clean`` and on to the star, the others to ``stg_quarantine``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_or_merge
from ..operators.ordering import checkpointed

# --- fixed values: staging columns (raw name → staging name), in table order
STAGING_RENAMES = [
    ("customerid", "customer_id"), ("gender", "gender"), ("seniorcitizen", "senior_citizen"),
    ("partner", "partner"), ("dependents", "dependents"), ("tenure", "tenure_months"),
    ("contract", "contract_type"), ("paperlessbilling", "paperless_billing"),
    ("paymentmethod", "payment_method"), ("phoneservice", "phone_service"),
    ("multiplelines", "multiple_lines"), ("internetservice", "internet_service"),
    ("onlinesecurity", "online_security"), ("onlinebackup", "online_backup"),
    ("deviceprotection", "device_protection"), ("techsupport", "tech_support"),
    ("streamingtv", "streaming_tv"), ("streamingmovies", "streaming_movies"),
    ("monthlycharges", "monthly_charges"), ("totalcharges", "total_charges"), ("churn", "churn"),
]
# Declared maximum lengths of the staging text columns.
STAGING_LENGTHS = {
    "customer_id": 20, "gender": 10, "senior_citizen": 3, "partner": 3, "dependents": 3,
    "contract_type": 30, "paperless_billing": 3, "payment_method": 50, "phone_service": 3,
    "multiple_lines": 20, "internet_service": 20, "online_security": 20, "online_backup": 20,
    "device_protection": 20, "tech_support": 20, "streaming_tv": 20, "streaming_movies": 20,
    "churn": 3,
}
MONEY = "decimal(10,2)"
# ----------------------------------------------------------------------------


def _t(raw_col: str) -> Column:
    # SQL TRIM: spaces only (a tab survives), like the source model.
    return F.trim(F.col(raw_col))


def _senior(raw: Column) -> Column:
    return F.when(raw == "1", F.lit("Yes")).when(raw == "0", F.lit("No"))


def _blank_to_null(raw_col: str) -> Column:
    return F.when((_t(raw_col) == "") | F.col(raw_col).isNull(), F.lit(None)).otherwise(_t(raw_col))


def _strict_cast(c: Column, t: str, name: str) -> Column:
    """Cast that fails the job on a malformed value whatever the session's ANSI
    setting (a plain cast silently yields NULL when ANSI mode is off)."""
    v = c.try_cast(t)
    return F.when(c.isNotNull() & v.isNull(), F.raise_error(F.concat(
        F.lit(f"stg_clean: {name} value '"), c, F.lit(f"' is not a valid {t}; see stg_quarantine")
    ))).otherwise(v)


def clean_columns(strict: bool = True) -> list[Column]:
    """Typed staging expressions over the raw columns; ``strict=False`` maps bad values to NULL."""
    def cast(c: Column, t: str, name: str) -> Column:
        return _strict_cast(c, t, name) if strict else c.try_cast(t)

    out = []
    for src, dst in STAGING_RENAMES:
        if dst == "senior_citizen":
            e = _senior(_t(src))
        elif dst == "tenure_months":
            e = cast(_t(src), "int", dst)
        elif dst == "monthly_charges":
            e = cast(_t(src), MONEY, dst)
        elif dst == "total_charges":
            e = cast(_blank_to_null(src), MONEY, dst)
        else:
            e = _t(src)
        out.append(e.alias(dst))
    return out


def stg_clean(raw: DataFrame) -> DataFrame:
    """raw (21 strings) → staging (21 typed columns + loaded_at)."""
    return raw.select(*clean_columns(strict=True), F.current_timestamp().alias("loaded_at"))


def _reasons(raw_cols_trimmed: dict[str, Column]) -> list[Column]:
    reasons = []
    for src, dst in STAGING_RENAMES:
        v = raw_cols_trimmed[src]
        if dst == "total_charges":
            blank = (v == "") | v.isNull()
            reasons.append(F.when(~blank & v.try_cast(MONEY).isNull(), F.lit(f"{dst}: not numeric(10,2)")))
            continue
        # one reason a column: a value that is missing breaks no other rule
        missing = F.when(F.col(src).isNull(), F.lit(f"{dst}: missing"))
        if dst == "senior_citizen":
            reasons.append(missing.when(~v.isin("0", "1"), F.lit(f"{dst}: unknown code")))
        elif dst == "tenure_months":
            reasons.append(missing.when(v.try_cast("int").isNull(), F.lit(f"{dst}: not integer")))
        elif dst == "monthly_charges":
            reasons.append(missing.when(v.try_cast(MONEY).isNull(), F.lit(f"{dst}: not numeric(10,2)")))
        else:
            reasons.append(missing.when(F.length(v) > STAGING_LENGTHS[dst], F.lit(f"{dst}: longer than {STAGING_LENGTHS[dst]}")))
    return reasons


def check_raw(raw: DataFrame) -> DataFrame:
    """raw plus ``reason``: the broken staging rules joined by '; ', empty if none.

    Rules: NULL in a NOT NULL column, unknown senior code, a number that does
    not cast, a text longer than its declared length, a duplicated customer id
    (all copies are marked).  Duplicates are found by a grouped count of the
    ids alone (map-side combined, so a hot id costs one row per task).  The
    repeated ids are frozen, so their number is known before the rows meet them:
    few are broadcast and the wide rows stay where they are; many are joined by a
    shuffle, where AQE splits a hot id.
    """
    trimmed = {src: _t(src) for src, _ in STAGING_RENAMES}
    copies = (
        raw.select(_t("customerid").alias("_id"))
        .where(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
    )
    joined = raw.withColumn("_id", _t("customerid")).join(broadcast_or_merge(checkpointed(copies)), "_id", "left")
    reasons = _reasons(trimmed) + [
        F.when(F.col("_copies").isNotNull(), F.concat(F.lit("customer_id: duplicated "), F.col("_copies").cast("string"), F.lit(" times")))
    ]
    return joined.select(*[F.col(src) for src, _ in STAGING_RENAMES], F.concat_ws("; ", *reasons).alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason") == "").drop("reason")


def stg_quarantine(checked: DataFrame) -> DataFrame:
    """The raw rows that break a rule, with their reasons."""
    return checked.where(F.col("reason") != "")
