"""Data-quality checks and layer reconciliation.

Checks return rows ``(check, subject, observed, expected, ok)`` instead of
printing; ``expected``/``ok`` are NULL where the check only reports.  A check
counts over all its columns in one ``agg`` per table, whose single row is then
exploded into the check's rows, so a table is scanned once; the orphan checks
share one pass of the fact that looks its four keys up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import avg_money, cents, money, pct, ratio
from ..operators.joins import broadcast_or_merge, never_broadcast
from .star import Star

# --- fixed values: columns the source model audits
STAGING_NULL_COLUMNS = ["customer_id", "gender", "senior_citizen", "tenure_months", "contract_type",
                        "monthly_charges", "total_charges", "churn"]
RAW_NULL_COLUMNS = ["customerid", "tenure", "monthlycharges", "totalcharges", "churn"]
YES_NO_COLUMNS = ["senior_citizen", "partner", "dependents", "phone_service", "paperless_billing", "churn"]
WHITESPACE_COLUMNS = ["customer_id", "gender", "contract_type", "payment_method"]


def _row(check: str, subject: str, observed: Column, expected: Column | None = None) -> list[Column]:
    exp = expected.cast("double") if expected is not None else F.lit(None).cast("double")
    obs = observed.cast("double")
    ok = (obs == exp) if expected is not None else F.lit(None).cast("boolean")
    return [F.lit(check).alias("check"), F.lit(subject).alias("subject"), obs.alias("observed"),
            exp.alias("expected"), ok.alias("ok")]


def _rows(one: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """The check's rows from the one row of counts."""
    return one.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


def _count(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def dq_row_counts(raw: DataFrame, staging: DataFrame, star: Star) -> DataFrame:
    """raw vs staging, staging vs fact (rows an inner dimension join dropped),
    and the row count of every star table."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()  # noqa: E731  (scalar subquery)
    counts = _count(raw, "raw").select(
        "raw",
        n(staging).alias("staging"),
        n(star.fact).alias("fact"),
        n(star.dim_customer).alias("dim_customer"),
        n(star.dim_contract).alias("dim_contract"),
        n(star.dim_service_plan).alias("dim_service_plan"),
        n(star.dim_tenure).alias("dim_tenure"),
    )
    return _rows(counts, [
        _row("row_count", "staging_vs_raw", F.col("staging"), F.col("raw")),
        _row("row_count", "fact_vs_staging", F.col("fact"), F.col("staging")),
        *[_row("table_rows", t, F.col(t)) for t in ["dim_contract", "dim_customer", "dim_service_plan", "dim_tenure"]],
        _row("table_rows", "fact_subscription", F.col("fact")),
    ])


def dq_nulls(raw: DataFrame, staging: DataFrame) -> DataFrame:
    """NULL counts of the audited staging and raw columns (one pass per table).
    NOT NULL columns expect 0; total_charges only reports."""
    s = staging.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in STAGING_NULL_COLUMNS])
    r = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in RAW_NULL_COLUMNS])
    return _rows(s, [
        _row("null_count", f"staging.{c}", F.col(c), None if c == "total_charges" else F.lit(0)) for c in STAGING_NULL_COLUMNS
    ]).unionByName(_rows(r, [_row("null_count", f"raw.{c}", F.col(c)) for c in RAW_NULL_COLUMNS]))


def dq_recode(raw: DataFrame, staging: DataFrame) -> DataFrame:
    """Senior-citizen values before (0/1) and after (Yes/No) the recode."""
    before = raw.groupBy(F.col("seniorcitizen").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    after = staging.groupBy(F.col("senior_citizen").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (
        before.select(F.lit("raw.seniorcitizen").alias("layer"), "value", "n")
        .unionByName(after.select(F.lit("staging.senior_citizen").alias("layer"), "value", "n"))
        .select("layer", "value", F.col("n").alias("customer_count"),
                F.when(F.col("layer").startswith("staging"), F.col("value").isin("Yes", "No")).alias("allowed"))
        .orderBy("layer", "value")
    )


def dq_blank_to_null(raw: DataFrame, staging: DataFrame) -> DataFrame:
    nulls = staging.agg(F.count_if(F.col("total_charges").isNull())).scalar()
    blanks = raw.agg(F.count_if((F.trim("totalcharges") == "") | F.col("totalcharges").isNull()).alias("b"))
    return blanks.select(*_row("blank_to_null", "total_charges", nulls, F.col("b")))


def dq_null_detail(staging: DataFrame) -> DataFrame:
    """Rows with unknown total charges; each should be a tenure-0 customer."""
    return staging.where(F.col("total_charges").isNull()).select(
        "customer_id", "tenure_months",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        F.col("total_charges").cast("double").alias("total_charges"),
        (F.col("tenure_months") == 0).alias("tenure_is_zero"),
    ).orderBy("customer_id")


def dq_range(staging: DataFrame) -> DataFrame:
    a = staging.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("tenure_months").alias("min_tenure"), F.max("tenure_months").alias("max_tenure"),
        F.sum("tenure_months").alias("_t"),
        F.min("monthly_charges").alias("min_monthly"), F.max("monthly_charges").alias("max_monthly"),
        F.sum(cents(F.col("monthly_charges"))).alias("_m"),
        F.min("total_charges").alias("min_total"), F.max("total_charges").alias("max_total"),
    )
    return a.select(
        "min_tenure", "max_tenure", ratio(F.col("_t"), F.col("_n"), 1).alias("avg_tenure"),
        F.col("min_monthly").cast("double").alias("min_monthly"),
        F.col("max_monthly").cast("double").alias("max_monthly"),
        avg_money(F.col("_m"), F.col("_n")).alias("avg_monthly"),
        F.col("min_total").cast("double").alias("min_total"),
        F.col("max_total").cast("double").alias("max_total"),
    )


def dq_domain(staging: DataFrame) -> DataFrame:
    """Values outside {Yes, No}; NULL is not counted (three-valued NOT IN)."""
    a = staging.agg(*[F.count_if(~F.col(c).isin("Yes", "No")).alias(c) for c in YES_NO_COLUMNS])
    return _rows(a, [_row("yes_no_domain", c, F.col(c), F.lit(0)) for c in YES_NO_COLUMNS])


def dq_whitespace(staging: DataFrame) -> DataFrame:
    a = staging.agg(*[F.count_if(F.col(c) != F.trim(F.col(c))).alias(c) for c in WHITESPACE_COLUMNS])
    return _rows(a, [_row("whitespace", c, F.col(c), F.lit(0)) for c in WHITESPACE_COLUMNS])


def dq_contract_mix(staging: DataFrame) -> DataFrame:
    g = staging.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum(cents(F.col("monthly_charges"))).alias("_m")
    )
    total = F.sum("customer_count").over(Window.partitionBy())  # few contract types
    return g.select(
        "contract_type", "customer_count", avg_money(F.col("_m"), F.col("customer_count")).alias("avg_monthly_charges"),
        pct(F.col("customer_count"), total).alias("pct_of_total"),
    ).orderBy("contract_type")


def dq_payment_mix(staging: DataFrame) -> DataFrame:
    return staging.groupBy("payment_method").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(
        F.desc("customer_count"), "payment_method"
    )


def dq_flag_consistency(star: Star) -> DataFrame:
    return star.fact.groupBy("churn", "is_churned").agg(F.count(F.lit(1)).alias("count")).orderBy("churn")


def dq_mrr_total(star: Star) -> DataFrame:
    return star.fact.agg(
        money(F.sum(cents(F.col("mrr_at_risk")))).alias("total_mrr_at_risk"),
        F.count_if(F.col("is_churned")).alias("churned_customers"),
    )


def dq_contract_revenue(star: Star) -> DataFrame:
    f = star.fact.join(broadcast_or_merge(star.dim_contract), "contract_key")
    g = f.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(cents(F.col("monthly_charges"))).alias("_m"),
        F.sum(F.when(F.col("is_churned"), 1).otherwise(0)).alias("churned"),
    )
    return g.select(
        "contract_type", "customers", money(F.col("_m")).alias("total_mrr"),
        avg_money(F.col("_m"), F.col("customers")).alias("avg_monthly"), F.col("churned").cast("bigint").alias("churned"),
    ).orderBy(F.desc("total_mrr"))


def dq_orphans(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Fact keys missing from each dimension (expected 0): one pass of the fact,
    which looks up customer, contract, service and date keys."""
    keys = {"customer": "customer_key", "contract": "contract_key", "service": "service_key", "date": "date_key"}
    f = fact.select(*keys.values())
    for name, key in keys.items():
        dim = dims[name].select(key).distinct() if name != "customer" else dims[name].select(key)
        known = dim.withColumn(f"_{name}", F.lit(True))
        f = f.join(never_broadcast(known) if name == "customer" else broadcast_or_merge(known), key, "left")
    a = f.agg(*[F.count_if(F.col(f"_{name}").isNull()).alias(name) for name in keys])
    return _rows(a, [_row("orphans", f"orphan_{name}", F.col(name), F.lit(0)) for name in keys])


def star_dims(star: Star) -> dict[str, DataFrame]:
    return {"customer": star.dim_customer, "contract": star.dim_contract, "service": star.dim_service_plan,
            "date": star.dim_tenure}


def dq_dim_listing(star: Star) -> DataFrame:
    """The rows of the contract and service dimensions, in key order."""
    def listed(name: str, dim: DataFrame, key: str) -> DataFrame:
        others = [c for c in dim.columns if c != key]
        return dim.select(F.lit(name).alias("dimension"), F.col(key).alias("key"),
                          F.concat_ws(" | ", *[F.col(c).cast("string") for c in others]).alias("attributes"))

    return listed("dim_contract", star.dim_contract, "contract_key").unionByName(
        listed("dim_service_plan", star.dim_service_plan, "service_key")).orderBy("dimension", "key")


def dq_dim_profile(star: Star) -> DataFrame:
    """Rows per dimension and the internet-tier split of the service dimension."""
    parts = [
        _count(star.dim_customer, "n").select(F.lit("dim_customer").alias("dimension"), F.lit("rows").alias("attribute"), F.lit(None).cast("string").alias("value"), F.col("n").alias("count")),
        _count(star.dim_contract, "n").select(F.lit("dim_contract"), F.lit("rows"), F.lit(None).cast("string"), F.col("n")),
        _count(star.dim_service_plan, "n").select(F.lit("dim_service_plan"), F.lit("rows"), F.lit(None).cast("string"), F.col("n")),
        _count(star.dim_tenure, "n").select(F.lit("dim_tenure"), F.lit("rows"), F.lit(None).cast("string"), F.col("n")),
        star.dim_service_plan.groupBy("internet_tier").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("dim_service_plan"), F.lit("internet_tier"), F.col("internet_tier"), F.col("n")
        ),
        star.dim_contract.groupBy("payment_category").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("dim_contract"), F.lit("payment_category"), F.col("payment_category"), F.col("n")
        ),
    ]
    return reduce(DataFrame.union, parts).orderBy("dimension", "attribute", "value")
