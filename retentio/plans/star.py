"""Star schema: customer, contract, service-plan and tenure dimensions around
a one-row-per-subscription fact.

Physical plan, per table:

* ``dim_tenure``   — ``spark.range(0, 73)``; 73 rows, always broadcast.
* ``dim_contract`` / ``dim_service_plan`` — the distinct combinations of both
  come from one scan of staging (grouping sets, map-side combined), frozen,
  counted, and keyed by a row number over
  *all* their natural columns (a plain window when the count is small, the
  distributed row number otherwise, both over frozen data), so the fact join
  can count the dimension cheaply and broadcast it behind that check.
* ``dim_customer`` — one range shuffle of staging on ``customer_id`` numbers
  the customers (key = position in customer-id order) and is frozen once.
  Staging is unique on ``customer_id``, so the staging⋈dim_customer lookup
  join of the source model is the identity and is not executed: the fact is
  built from the same numbered rows.
* the fact — numbered staging meets the three small dimensions by broadcast
  hash joins on their natural keys (inner joins, like the source: a row whose
  tenure falls outside 0–72 drops out, and ``dq_row_counts`` reports it).
  It is written once, with the dimension attributes next to the keys; in
  Parquet the extra columns cost nothing to a reader that does not select
  them, and every report becomes a single pruned scan without joins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.joins import broadcast_or_merge
from ..operators import ordering
from ..operators.ordering import checkpointed, row_numbers

# --- fixed values: columns of the fact
FACT_COLUMNS = [
    "subscription_key", "customer_key", "contract_key", "service_key", "date_key", "customer_id",
    "tenure_months", "monthly_charges", "total_charges", "estimated_clv", "mrr_at_risk", "churn",
    "is_churned", "loaded_at",
]


class Star:
    """Lazily built star over a staging DataFrame."""

    def __init__(self, staging: DataFrame, max_broadcast_rows: int = 1_000_000):
        self.staging = staging
        self.spark = staging.sparkSession
        self.max_broadcast_rows = max_broadcast_rows

    # -- small dimensions ----------------------------------------------------
    @cached_property
    def dim_tenure(self) -> DataFrame:
        t = F.col("id").cast("int")
        return self.spark.range(0, R.MAX_TENURE + 1, numPartitions=1).select(
            t.alias("date_key"),
            t.alias("tenure_months"),
            R.tenure_bucket(t).alias("tenure_bucket"),
            R.tenure_year(t).alias("tenure_year"),
            R.is_new_customer(t).alias("is_new_customer"),
            R.is_long_term(t).alias("is_long_term"),
        )

    @cached_property
    def _combos(self) -> DataFrame:
        """Distinct contract and service combinations from ONE scan of staging:
        grouping sets over the two natural keys, map-side combined, frozen."""
        g = self.staging.groupingSets([R.CONTRACT_COLUMNS, R.SERVICE_COLUMNS], *R.CONTRACT_COLUMNS, *R.SERVICE_COLUMNS)
        return checkpointed(g.agg(F.grouping(R.SERVICE_COLUMNS[0]).alias("_contract_set")))

    @cached_property
    def dim_contract(self) -> DataFrame:
        combos = self._combos.where(F.col("_contract_set") == 1).select(*R.CONTRACT_COLUMNS)
        keyed = row_numbers(combos, R.CONTRACT_COLUMNS, rn="contract_key", small_rows=ordering.SMALL_ROWS)
        return keyed.select(
            F.col("contract_key").cast("long"),
            *R.CONTRACT_COLUMNS,
            R.payment_category(F.col("payment_method")).alias("payment_category"),
            R.contract_length(F.col("contract_type")).alias("contract_length"),
        )

    @cached_property
    def dim_service_plan(self) -> DataFrame:
        combos = self._combos.where(F.col("_contract_set") == 0).select(*R.SERVICE_COLUMNS)
        keyed = row_numbers(combos, R.SERVICE_COLUMNS, rn="service_key", small_rows=ordering.SMALL_ROWS)
        return keyed.select(
            F.col("service_key").cast("long"),
            *R.SERVICE_COLUMNS,
            R.total_addons().alias("total_addons"),
            R.internet_tier(F.col("internet_service")).alias("internet_tier"),
        )

    # -- customer numbering --------------------------------------------------
    @cached_property
    def _numbered(self) -> DataFrame:
        """Staging + customer_key (1-based position in customer_id order), frozen."""
        return row_numbers(self.staging, ["customer_id"], rn="customer_key").withColumn(
            "customer_key", F.col("customer_key").cast("long")
        )

    @cached_property
    def dim_customer(self) -> DataFrame:
        s = self._numbered
        return s.select(
            "customer_key", "customer_id", "gender", "senior_citizen", "partner", "dependents",
            R.household_type(F.col("partner"), F.col("dependents")).alias("household_type"),
            R.senior_segment(F.col("senior_citizen")).alias("senior_segment"),
        )

    # -- fact ----------------------------------------------------------------
    def _small(self, df: DataFrame) -> DataFrame:
        return broadcast_or_merge(df, self.max_broadcast_rows)

    @cached_property
    def fact_enriched(self) -> DataFrame:
        """The fact with every dimension's attributes alongside its keys
        (customer attributes come from the same numbered rows, not from a
        join), written once as a Parquet table.  Analyses scan it with column
        pruning and need no join at all; ``fact`` is its normalized projection."""
        s = self._numbered
        contract = self._small(self.dim_contract)
        service = self._small(self.dim_service_plan)
        tenure = F.broadcast(self.dim_tenure)
        j = (
            s.join(contract, R.CONTRACT_COLUMNS, "inner")
            .join(service, R.SERVICE_COLUMNS, "inner")
            .join(tenure, "tenure_months", "inner")
        )
        m, t, tot = F.col("monthly_charges"), F.col("tenure_months"), F.col("total_charges")
        return checkpointed(j.select(
            F.col("customer_key").alias("subscription_key"),
            "customer_key", "contract_key", "service_key", "date_key", "customer_id",
            "tenure_months", "monthly_charges", "total_charges",
            R.estimated_clv(m, t, tot).alias("estimated_clv"),
            R.mrr_at_risk(m, F.col("churn")).alias("mrr_at_risk"),
            "churn",
            (F.col("churn") == "Yes").alias("is_churned"),
            "loaded_at",
            # customer attributes
            "gender", "senior_citizen", "partner", "dependents",
            R.household_type(F.col("partner"), F.col("dependents")).alias("household_type"),
            R.senior_segment(F.col("senior_citizen")).alias("senior_segment"),
            # contract attributes
            *R.CONTRACT_COLUMNS, "payment_category", "contract_length",
            # service attributes
            *R.SERVICE_COLUMNS, "total_addons", "internet_tier",
            # tenure attributes
            "tenure_bucket", "tenure_year", "is_new_customer", "is_long_term",
        ))

    @cached_property
    def fact(self) -> DataFrame:
        return self.fact_enriched.select(*FACT_COLUMNS)

    @cached_property
    def cube(self):
        """The dashboard's partial sums over the fact (``plans/cube.py``)."""
        from .cube import Cube

        return Cube(self)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_customer": self.dim_customer,
            "dim_contract": self.dim_contract,
            "dim_service_plan": self.dim_service_plan,
            "dim_tenure": self.dim_tenure,
            "fact_subscription": self.fact,
        }
