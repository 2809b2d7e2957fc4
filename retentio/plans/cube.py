"""Partial sums behind the dashboard, by its filter dimensions.

A *cell* is a combination of the filter dimensions with sums over its
customers.  All sums are integers (counts, cents, months), so cells of any
number of rows, partitions or loads merge by addition and a dataset rolled up
from them equals the one computed from the fact, to the last digit.

``unit_cells`` gives every customer as a cell of its own: the datasets of
``plans/dashboard.py`` are written once, over cells, and read either those or
the stored cube.  The cube is written once with the star.  Its size depends on
the dimensions (some ten thousand cells), not on the customers, so a report
under any filters reads no fact file.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rounding import cents
from ..operators.ordering import checkpointed

# --- fixed values: the dimensions that dashboard filters and groupings use, and the service types of the services tab
FILTER_DIMENSIONS = ["gender", "senior_citizen", "partner", "dependents", "tenure_bucket", "contract_type",
                     "internet_service", "payment_method", "risk_tier"]
DASHBOARD_SERVICES = [
    ("Phone Service", "phone_service"), ("Multiple Lines", "multiple_lines"),
    ("Online Security", "online_security"), ("Online Backup", "online_backup"),
    ("Device Protection", "device_protection"), ("Tech Support", "tech_support"),
    ("Streaming TV", "streaming_tv"), ("Streaming Movies", "streaming_movies"),
]
NO_SERVICE = ["No internet service", "No phone service"]
# Add-on count at which the segment table groups customers together ("6+").
ADDON_CAP = 6
# ---------------------------------------------------------------------------------
HIGH_MAX_TENURE = 12
#: cents by which the cube cuts monthly charges; bins of a dataset are multiples of it
CHARGE_STEP = 500

MEASURES = ["customers", "churned", "mrr", "risk", "clv", "clv_n", "tenure",
            *[f"{c}_{m}" for _, c in DASHBOARD_SERVICES for m in ("yes", "yes_churned", "no", "no_churned", "none")]]


def risk_tier(high_max_tenure: int = HIGH_MAX_TENURE) -> Column:
    m2m = F.col("contract_type") == R.MONTH_TO_MONTH
    return (
        F.when(F.col("is_churned"), F.lit("Churned"))
        .when(m2m & (F.col("tenure_months") <= high_max_tenure), F.lit("High Risk"))
        .when(m2m, F.lit("Medium Risk"))
        .otherwise(F.lit("Low Risk"))
    )


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _derived() -> dict[str, Column]:
    """Attributes that follow from a cell's dimensions."""
    return {
        "internet_tier": R.internet_tier(F.col("internet_service")), "senior_segment": R.senior_segment(F.col("senior_citizen")),
        "household_type": R.household_type(F.col("partner"), F.col("dependents")),
        "payment_category": R.payment_category(F.col("payment_method")), "contract_length": R.contract_length(F.col("contract_type")),
    }


def unit_cells(fact_enriched: DataFrame, high_max_tenure: int = HIGH_MAX_TENURE) -> DataFrame:
    """Every row of the fact as a cell (and its other columns, which cost nothing unless they are used)."""
    churned = F.col("is_churned")
    sums = {"customers": F.lit(1).cast("bigint"), "churned": _one_if(churned), "mrr": cents(F.col("monthly_charges")),
            "risk": F.coalesce(cents(F.col("mrr_at_risk")), F.lit(0).cast("bigint")),
            "clv": F.coalesce(cents(F.col("estimated_clv")), F.lit(0).cast("bigint")),
            "clv_n": _one_if(F.col("estimated_clv").isNotNull()), "tenure": F.col("tenure_months").cast("bigint")}
    for _, c in DASHBOARD_SERVICES:
        v = F.col(c)
        sums |= {f"{c}_yes": _one_if(v == "Yes"), f"{c}_yes_churned": _one_if((v == "Yes") & churned), f"{c}_no": _one_if(v == "No"),
                 f"{c}_no_churned": _one_if((v == "No") & churned), f"{c}_none": _one_if(v.isin(NO_SERVICE))}
    addons = F.when(F.col("total_addons") >= ADDON_CAP, F.lit(f"{ADDON_CAP}+")).otherwise(F.col("total_addons").cast("string"))
    charge = cents(F.col("monthly_charges"))
    return fact_enriched.withColumns({
        "risk_tier": risk_tier(high_max_tenure), "addon_group": addons,
        "charge_step": (charge - F.pmod(charge, F.lit(CHARGE_STEP))), **sums})


class Cube:
    """The cells of a star, stored; built from the fact by one aggregation each, combined map-side."""

    def __init__(self, star=None, cells: DataFrame | None = None, charges: DataFrame | None = None):
        self._star, self._cells, self._charges = star, cells, charges

    @cached_property
    def stored_cells(self) -> DataFrame:
        if self._cells is not None:
            return self._cells
        by = [*FILTER_DIMENSIONS, "addon_group"]
        return checkpointed(unit_cells(self._star.fact_enriched).groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES]))

    @cached_property
    def stored_charges(self) -> DataFrame:
        if self._charges is not None:
            return self._charges
        by = [*FILTER_DIMENSIONS, "charge_step"]
        return checkpointed(unit_cells(self._star.fact_enriched).groupBy(*by).agg(*[F.sum(m).alias(m) for m in ("customers", "mrr")]))

    @property
    def cells(self) -> DataFrame:
        return self.stored_cells.withColumns(_derived())

    @property
    def charges(self) -> DataFrame:
        return self.stored_charges.withColumns(_derived())

    def tables(self) -> dict[str, DataFrame]:
        return {"cube_cells": self.stored_cells, "cube_charges": self.stored_charges}


def cells_of(source, high_max_tenure: int = HIGH_MAX_TENURE) -> DataFrame:
    """The cells of a cube, or of a star's fact."""
    if isinstance(source, Cube):
        if high_max_tenure != HIGH_MAX_TENURE:
            raise ValueError(f"the cube's risk tiers are those of {HIGH_MAX_TENURE} months; give the star")
        return source.cells
    return unit_cells(source.fact_enriched, high_max_tenure)


def charges_of(source, width: int) -> DataFrame:
    """Cells by charge, the lower end of whose bin of ``width`` cents is ``lo``."""
    if isinstance(source, Cube):
        if width % CHARGE_STEP:
            raise ValueError(f"the cube's charges are cut by {CHARGE_STEP} cents; give the star")
        c = F.col("charge_step")
        return source.charges.withColumn("lo", c - F.pmod(c, F.lit(width)))
    c = cents(F.col("monthly_charges"))
    return unit_cells(source.fact_enriched).withColumn("lo", c - F.pmod(c, F.lit(width)))
