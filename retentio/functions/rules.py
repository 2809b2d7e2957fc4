"""Business rules of the subscription model, as Spark column expressions.

The category labels, band edges and service lists below are fixed values:
results are only comparable when they equal the source model's wording.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Add-on services counted in total_addons (phone_service is not an add-on).
ADDON_COLUMNS = [
    "multiple_lines", "online_security", "online_backup", "device_protection",
    "tech_support", "streaming_tv", "streaming_movies",
]
# All nine service columns of the service-plan dimension, in model order.
SERVICE_COLUMNS = [
    "phone_service", "multiple_lines", "internet_service", "online_security",
    "online_backup", "device_protection", "tech_support", "streaming_tv",
    "streaming_movies",
]
# Contract natural key.
CONTRACT_COLUMNS = ["contract_type", "payment_method", "paperless_billing"]
# Household types from (partner, dependents).
HOUSEHOLD_FAMILY = "Family"
HOUSEHOLD_COUPLE = "Couple No Dependents"
HOUSEHOLD_SINGLE_PARENT = "Single With Dependents"
HOUSEHOLD_SINGLE = "Single No Dependents"
UNKNOWN = "Unknown"
# Contract type → contract length.
CONTRACT_LENGTHS = [("Month-to-month", "Monthly"), ("One year", "Annual"), ("Two year", "Two-Year")]
# Internet service → internet tier.
INTERNET_TIERS = [("Fiber optic", "Fiber Optic"), ("DSL", "DSL"), ("No", "No Internet")]
# Tenure bands (inclusive month ranges); everything above the last is '61+ months'.
TENURE_BANDS = [(0, 12, "0-12 months"), (13, 24, "13-24 months"), (25, 36, "25-36 months"),
                (37, 48, "37-48 months"), (49, 60, "49-60 months")]
TENURE_TOP_BAND = "61+ months"
MAX_TENURE = 72
NEW_CUSTOMER_MAX_TENURE = 12
LONG_TERM_MIN_TENURE = 48
MONTH_TO_MONTH = "Month-to-month"
# ----------------------------------------------------------------------------


def household_type(partner: Column, dependents: Column) -> Column:
    return (
        F.when((partner == "Yes") & (dependents == "Yes"), F.lit(HOUSEHOLD_FAMILY))
        .when((partner == "Yes") & (dependents == "No"), F.lit(HOUSEHOLD_COUPLE))
        .when((partner == "No") & (dependents == "Yes"), F.lit(HOUSEHOLD_SINGLE_PARENT))
        .when((partner == "No") & (dependents == "No"), F.lit(HOUSEHOLD_SINGLE))
        .otherwise(F.lit(UNKNOWN))
    )


def senior_segment(senior_citizen: Column) -> Column:
    return F.when(senior_citizen == "Yes", F.lit("Senior")).otherwise(F.lit("Non-Senior"))


def payment_category(payment_method: Column) -> Column:
    return F.when(payment_method.ilike("%automatic%"), F.lit("Automatic")).otherwise(F.lit("Manual"))


def _lookup(col: Column, pairs: list[tuple[str, str]]) -> Column:
    expr = None
    for src, dst in pairs:
        expr = F.when(col == src, F.lit(dst)) if expr is None else expr.when(col == src, F.lit(dst))
    return expr.otherwise(F.lit(UNKNOWN))


def contract_length(contract_type: Column) -> Column:
    return _lookup(contract_type, CONTRACT_LENGTHS)


def internet_tier(internet_service: Column) -> Column:
    return _lookup(internet_service, INTERNET_TIERS)


def total_addons(*addon_cols: Column) -> Column:
    cols = addon_cols or tuple(F.col(c) for c in ADDON_COLUMNS)
    total = None
    for c in cols:
        term = F.when(c == "Yes", F.lit(1)).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total.cast("int")


def tenure_bucket(tenure: Column) -> Column:
    expr = None
    for lo, hi, label in TENURE_BANDS:
        cond = tenure.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(TENURE_TOP_BAND))


def tenure_year(tenure: Column) -> Column:
    """1-based tenure year: ceil(max(t, 1) / 12); integer form of the same rule."""
    t = F.greatest(tenure, F.lit(1))
    return ((t + F.lit(11) - F.pmod(t + F.lit(11), F.lit(12))) / F.lit(12)).cast("int")


def is_new_customer(tenure: Column) -> Column:
    return tenure <= NEW_CUSTOMER_MAX_TENURE


def is_long_term(tenure: Column) -> Column:
    return tenure >= LONG_TERM_MIN_TENURE


def estimated_clv(monthly: Column, tenure: Column, total: Column) -> Column:
    """monthly × tenure (exact at 2 decimals); NULL when total charges are unknown."""
    return F.when(total.isNotNull(), (monthly * tenure).cast("decimal(12,2)"))


def mrr_at_risk(monthly: Column, churn: Column) -> Column:
    """Monthly revenue of customers who already churned."""
    return F.when(churn == "Yes", monthly)
