"""The 26 analyses over the star (KPIs, churn, revenue, segments, windows, CTE reports).

Every function takes a ``Star`` and returns a DataFrame whose computed
columns are aliased to the names the reports use.  Money is summed as exact
integer cents and every ratio is rounded half-up with integer arithmetic
(``functions.rounding``), so figures equal the decimal results of the source
model to the cent.

Plan notes
* Grouped reports are one partial+final hash aggregate over the fact, which
  already carries its small dimensions through broadcast joins.
* Windows that run after an aggregation (q5c, q5d, q5f, q6b, q6c) see at most
  a few dozen rows, so a plain global window is right there.
* Windows over the whole customer base (q4a, q5b, q6a) use the distributed
  ordering operators; no ``Exchange SinglePartition`` over fact rows.  The
  NTILE quintiles of q4a/q6a come from ``ntile_column``: the few tile
  boundaries are found from distinct-value counts and each row is labelled in
  place, so the fact is never shuffled for them.
* Ties: every ROW_NUMBER / NTILE / LIMIT order ends in ``customer_id`` (or
  the segment columns) so results are deterministic; RANK and DENSE_RANK keep
  the plain key.  ``estimated_clv DESC`` sorts NULLs first, as the source
  database does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rounding import avg_money, cents, money, pct, pct_units, ratio, round_units, scaled
from ..operators.ordering import ntile, ntile_column
from ..operators.percentiles import order_statistics, round_half_up_units
from .star import Star

# --- aggregate building blocks -------------------------------------------------


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_churned() -> Column:
    return F.count(F.when(F.col("is_churned"), F.lit(1)))


def sum_cents(col: str, where: Column | None = None) -> Column:
    c = cents(F.col(col))
    return F.sum(c if where is None else F.when(where, c))


# Named measures: ({alias: partial aggregate}, final expression over those aliases).
def _measure(name: str) -> tuple[dict[str, Column], Column]:
    n, ch = F.col("_n"), F.col("_churned")
    count = {"_n": n_rows()}
    churned = {"_churned": n_churned()}
    mrr = {"_mrr": sum_cents("monthly_charges")}
    risk = {"_risk": sum_cents("mrr_at_risk")}
    m = {
        "total_customers": (count, n),
        "customers": (count, n),
        "churned": (churned, ch),
        "churned_customers": (churned, ch),
        "churn_rate_pct": ({**count, **churned}, pct(ch, n)),
        "avg_monthly_charges": ({**count, **mrr}, avg_money(F.col("_mrr"), n)),
        "avg_monthly": ({**count, **mrr}, avg_money(F.col("_mrr"), n)),
        "total_mrr": (mrr, money(F.col("_mrr"))),
        "mrr_at_risk": (risk, money(F.col("_risk"))),
        "total_lifetime_revenue": ({"_ltv": sum_cents("total_charges")}, money(F.col("_ltv"))),
        "pct_mrr_at_risk": ({**risk, **mrr}, pct(F.col("_risk"), F.col("_mrr"))),
    }
    return m[name]


def summarize(df: DataFrame, by: list[str], measures: list[str], keep: list[str] = ()) -> DataFrame:
    """``GROUP BY by`` with the named measures; shared partial aggregates are computed once."""
    aggs: dict[str, Column] = {}
    finals = []
    for name in measures:
        parts, final = _measure(name)
        for alias, agg in parts.items():
            aggs.setdefault(alias, agg.alias(alias))
        finals.append(final.alias(name))
    grouped = df.groupBy(*by).agg(*aggs.values()) if by else df.agg(*aggs.values())
    return grouped.select(*by, *keep, *finals)


def _fact(star: Star) -> DataFrame:
    return star.fact_enriched


# --- section 1: KPIs ------------------------------------------------------------


def q1a_kpi_topline(star: Star) -> DataFrame:
    f = _fact(star)
    active = ~F.col("is_churned")
    agg = f.agg(
        n_rows().alias("_n"),
        F.count(F.when(active, 1)).alias("_active"),
        n_churned().alias("_churned"),
        sum_cents("monthly_charges").alias("_mrr"),
        sum_cents("monthly_charges", active).alias("_active_mrr"),
        sum_cents("mrr_at_risk").alias("_risk"),
        F.sum("tenure_months").alias("_tenure"),
        sum_cents("estimated_clv", active).alias("_clv_active"),
    )
    return agg.select(
        F.col("_n").alias("total_customers"),
        F.col("_active").alias("active_customers"),
        F.col("_churned").alias("churned_customers"),
        pct(F.col("_churned"), F.col("_n")).alias("churn_rate_pct"),
        money(F.col("_mrr")).alias("total_mrr"),
        money(F.col("_active_mrr")).alias("active_mrr"),
        money(F.col("_risk")).alias("mrr_at_risk"),
        ratio(F.col("_tenure"), F.col("_n"), 1).alias("avg_tenure_months"),
        avg_money(F.col("_mrr"), F.col("_n")).alias("avg_monthly_charges"),
        avg_money(F.col("_clv_active"), F.col("_active")).alias("avg_clv_active"),
    )


def q1b_mrr_at_risk_pct(star: Star) -> DataFrame:
    f = _fact(star)
    agg = f.agg(
        sum_cents("monthly_charges").alias("_mrr"),
        sum_cents("monthly_charges", F.col("is_churned")).alias("_risk"),
    )
    return agg.select(
        money(F.col("_mrr")).alias("total_mrr"),
        money(F.col("_risk")).alias("mrr_at_risk"),
        pct(F.col("_risk"), F.col("_mrr")).alias("pct_mrr_at_risk"),
    )


# --- section 2: churn -----------------------------------------------------------

_RATE = ["total_customers", "churned", "churn_rate_pct"]


def q2a_churn_by_contract(star: Star) -> DataFrame:
    return summarize(_fact(star), ["contract_type"], _RATE + ["avg_monthly_charges", "mrr_at_risk"]).orderBy(
        F.desc("churn_rate_pct"), "contract_type"
    )


def q2b_churn_by_internet(star: Star) -> DataFrame:
    return summarize(_fact(star), ["internet_service"], _RATE + ["avg_monthly_charges"]).orderBy(
        F.desc("churn_rate_pct"), "internet_service"
    )


def q2c_churn_by_payment(star: Star) -> DataFrame:
    return summarize(_fact(star), ["payment_method", "payment_category"], _RATE).orderBy(
        F.desc("churn_rate_pct"), "payment_method"
    )


def q2d_churn_by_tenure(star: Star) -> DataFrame:
    f = _fact(star)
    by = ["tenure_bucket", "is_new_customer", "is_long_term"]
    out = (
        f.groupBy(*by)
        .agg(
            n_rows().alias("_n"), n_churned().alias("_churned"),
            sum_cents("monthly_charges").alias("_mrr"), F.min("tenure_months").alias("_first"),
        )
    )
    return out.orderBy("_first").select(
        *by,
        F.col("_n").alias("total_customers"),
        F.col("_churned").alias("churned"),
        pct(F.col("_churned"), F.col("_n")).alias("churn_rate_pct"),
        avg_money(F.col("_mrr"), F.col("_n")).alias("avg_monthly_charges"),
    )


def q2e_churn_by_senior(star: Star) -> DataFrame:
    return summarize(_fact(star), ["senior_segment"], _RATE + ["avg_monthly_charges"]).orderBy(
        F.desc("churn_rate_pct"), "senior_segment"
    )


def q2f_churn_by_addons(star: Star) -> DataFrame:
    return summarize(_fact(star), ["total_addons"], _RATE).orderBy("total_addons")


def q2g_churn_contract_internet(star: Star) -> DataFrame:
    return summarize(_fact(star), ["contract_type", "internet_service"], _RATE + ["mrr_at_risk"]).orderBy(
        F.desc("churn_rate_pct"), "contract_type", "internet_service"
    )


# --- section 3: revenue -----------------------------------------------------------


def q3a_revenue_by_contract(star: Star) -> DataFrame:
    return summarize(
        _fact(star), ["contract_type", "contract_length"],
        ["customers", "total_mrr", "avg_monthly_charges", "total_lifetime_revenue", "mrr_at_risk", "pct_mrr_at_risk"],
    ).orderBy(F.desc("total_mrr"))


def q3b_revenue_by_tier(star: Star) -> DataFrame:
    return summarize(
        _fact(star), ["internet_tier"], ["customers", "total_mrr", "avg_monthly_charges", "mrr_at_risk"]
    ).orderBy(F.desc("total_mrr"))


def q3c_revenue_by_payment_category(star: Star) -> DataFrame:
    return summarize(
        _fact(star), ["payment_category"],
        ["customers", "total_mrr", "avg_monthly_charges", "churned_customers", "mrr_at_risk"],
    ).orderBy(F.desc("total_mrr"))


def q3d_clv_by_contract(star: Star) -> DataFrame:
    f = _fact(star)
    clv = F.col("estimated_clv")
    agg = f.groupBy("contract_type").agg(
        n_rows().alias("_n"),
        F.sum("tenure_months").alias("_tenure"),
        F.sum(cents(clv)).alias("_clv"),
        F.count(clv).alias("_clv_n"),
        F.max(clv).alias("_max"),
        F.min(F.when(clv > 0, clv)).alias("_min"),
    )
    return agg.select(
        "contract_type",
        ratio(F.col("_tenure"), F.col("_n"), 1).alias("avg_tenure_months"),
        avg_money(F.col("_clv"), F.col("_clv_n")).alias("avg_estimated_clv"),
        F.col("_max").cast("double").alias("max_clv"),
        F.col("_min").cast("double").alias("min_clv"),
    ).orderBy(F.desc("avg_estimated_clv"))


# --- section 4: segmentation ----------------------------------------------------------


def q4a_high_value_active(star: Star, tiles: int = 5, min_tenure: int = 12, top: int = 50) -> DataFrame:
    """Top ``top`` by CLV among the first charge quintile of active customers
    with tenure >= ``min_tenure`` (the quintiles are of that subset)."""
    cols = [
        "customer_id", "monthly_charges", "tenure_months", "estimated_clv", "gender", "senior_segment",
        "household_type", "contract_type", "internet_tier", "total_addons",
    ]
    base = _fact(star).where(~F.col("is_churned") & (F.col("tenure_months") >= min_tenure)).select(*cols)
    q = ntile_column(base, "monthly_charges", "customer_id", tiles, name="charge_quintile").withColumn(
        "charge_quintile", F.col("charge_quintile").cast("long")
    )
    return (
        q.where(F.col("charge_quintile") == 1)
        .select(*cols[:3], F.col("estimated_clv").cast("double").alias("estimated_clv"), *cols[4:], "charge_quintile")
        .withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
        .orderBy(F.col("estimated_clv").desc_nulls_first(), "customer_id")
        .limit(top)
    )


def q4b_at_risk_customers(star: Star, max_tenure: int = 12) -> DataFrame:
    """Churned customers and new month-to-month ones, labelled against the
    average monthly charge (compared exactly: charge·n > Σ charges)."""
    f = _fact(star)
    # average charge as two scalar subqueries (Σ cents, n); compared exactly as charge·n > Σ
    total_c = f.agg(sum_cents("monthly_charges").cast("decimal(38,0)")).scalar()
    n = f.agg(n_rows()).scalar()
    m2m_new = (F.col("contract_type") == R.MONTH_TO_MONTH) & (F.col("tenure_months") <= max_tenure)
    above_avg = cents(F.col("monthly_charges")).cast("decimal(38,0)") * n > total_c
    risk = (
        F.when(F.col("is_churned"), F.lit("Churned"))
        .when(m2m_new & above_avg, F.lit("High Risk"))
        .when(m2m_new, F.lit("Medium Risk"))
        .otherwise(F.lit("Low Risk"))
    )
    return (
        f.where(F.col("is_churned") | m2m_new)
        .select(
            "customer_id",
            F.col("churn").alias("churned"),
            "tenure_months",
            F.col("monthly_charges").cast("double").alias("monthly_charges"),
            F.col("mrr_at_risk").cast("double").alias("mrr_at_risk"),
            "contract_type", "payment_method", "internet_service", "total_addons",
            risk.alias("risk_segment"),
        )
        .orderBy(F.desc("monthly_charges"), "customer_id")
    )


def q4c_household_summary(star: Star) -> DataFrame:
    return summarize(
        _fact(star), ["household_type"], _RATE + ["avg_monthly_charges", "total_mrr"]
    ).orderBy(F.desc("churn_rate_pct"), "household_type")


# --- section 5: windows ---------------------------------------------------------------


def q5a_clv_rank_in_contract(star: Star, top: int = 30) -> DataFrame:
    """ROW_NUMBER by CLV (NULLs first) within contract type; first ``top`` rows in
    (contract, rank) order.  Only rows with rank <= top can appear, so the
    window is limited per contract before it is computed: Spark plans a
    partial WindowGroupLimit on the map side and the 3-key shuffle carries at
    most ``top`` rows per contract per task."""
    f = _fact(star).select(
        "customer_id", "contract_type", "monthly_charges", "tenure_months", "estimated_clv", "churn"
    )
    w = Window.partitionBy("contract_type").orderBy(F.col("estimated_clv").desc_nulls_first(), F.col("customer_id"))
    ranked = f.withColumn("clv_rank_within_contract", F.row_number().over(w)).where(
        F.col("clv_rank_within_contract") <= top
    )
    return (
        ranked.select(
            "customer_id", "contract_type",
            F.col("monthly_charges").cast("double").alias("monthly_charges"),
            "tenure_months",
            F.col("estimated_clv").cast("double").alias("estimated_clv"),
            "churn",
            F.col("clv_rank_within_contract").cast("long").alias("clv_rank_within_contract"),
        )
        .orderBy("contract_type", "clv_rank_within_contract")
        .limit(top)
    )


def q5b_charge_rank(star: Star, top: int = 20, tiles: int = 4) -> DataFrame:
    """RANK / DENSE_RANK / NTILE(4) by monthly charge, first ``top`` by rank.

    The first ``top`` rows by (charge DESC, customer_id) are exactly the rows
    with the smallest ranks, and every row that outranks one of them is among
    them; so their RANK and DENSE_RANK follow from the top rows alone, and
    NTILE needs only the total count.  One distributed top-k
    (TakeOrderedAndProject) plus one count replace three whole-table windows.
    """
    f = _fact(star)
    total = f.agg(n_rows()).scalar()
    head = f.select("customer_id", "monthly_charges", "tenure_months", "churn", "contract_type").orderBy(
        F.desc("monthly_charges"), "customer_id"
    ).limit(top)
    w = Window.orderBy(F.desc("monthly_charges"), "customer_id")  # over ``top`` rows only
    ranked = (
        head.withColumn("_size", total)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("charge_rank", F.rank().over(Window.orderBy(F.desc("monthly_charges"))))
        .withColumn("charge_dense_rank", F.dense_rank().over(Window.orderBy(F.desc("monthly_charges"))))
    )
    return ranked.select(
        "customer_id",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        "tenure_months", "churn", "contract_type",
        F.col("charge_rank").cast("long").alias("charge_rank"),
        F.col("charge_dense_rank").cast("long").alias("charge_dense_rank"),
        ntile(F.col("_rn"), F.col("_size"), tiles).cast("long").alias("charge_quartile"),
    ).orderBy("charge_rank", "customer_id")


def q5c_running_mrr(star: Star) -> DataFrame:
    f = _fact(star)
    per_month = f.groupBy("tenure_months", "tenure_bucket").agg(
        n_rows().alias("customers"), sum_cents("monthly_charges").alias("_mrr")
    )
    run = Window.orderBy("tenure_months")  # <= 73 aggregated rows
    return per_month.select(
        "tenure_months", "tenure_bucket", "customers",
        money(F.col("_mrr")).alias("mrr"),
        money(F.sum("_mrr").over(run)).alias("running_total_mrr"),
        F.sum("customers").over(run).alias("running_total_customers"),
        pct(F.col("_mrr"), F.sum("_mrr").over(Window.partitionBy())).alias("pct_of_total_mrr"),
    ).orderBy("tenure_months")


def q5d_bucket_lag_lead(star: Star) -> DataFrame:
    f = _fact(star)
    b = f.groupBy("tenure_bucket").agg(
        F.min("tenure_months").alias("_min"), n_rows().alias("total_customers"), n_churned().alias("churned")
    ).withColumn("_rate", pct_units(F.col("churned"), F.col("total_customers")))
    w = Window.orderBy("_min")  # 6 aggregated rows
    prev = F.lag("_rate").over(w)
    return b.select(
        "tenure_bucket", "total_customers", "churned",
        scaled(F.col("_rate"), 2).alias("churn_rate_pct"),
        scaled(prev, 2).alias("prev_bucket_churn_pct"),
        scaled(F.lead("_rate").over(w), 2).alias("next_bucket_churn_pct"),
        scaled(F.col("_rate") - prev, 2).alias("churn_rate_change"),
        "_min",
    ).orderBy("_min").drop("_min")


def q5e_charge_percentiles(star: Star) -> DataFrame:
    f = _fact(star)
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    # quantiles and exact moments from one (value, count) table of the cent amounts
    stats = order_statistics(f.select(cents(F.col("monthly_charges")).alias("_c")), "_c", probs, moments=True)
    n = F.col("n").cast("decimal(38,0)")
    # sample stddev: sqrt((n·Σx² − (Σx)²) / (n(n−1))) cents
    var_num = n * F.col("sum_sq") - F.col("sum") * F.col("sum")
    sd_cents = F.sqrt(var_num.cast("double") / (n * (n - 1)).cast("double"))
    return stats.select(
        scaled(round_half_up_units("p25"), 2).alias("p25_monthly"),
        scaled(round_half_up_units("p50"), 2).alias("median_monthly"),
        scaled(round_half_up_units("p75"), 2).alias("p75_monthly"),
        scaled(round_half_up_units("p90"), 2).alias("p90_monthly"),
        avg_money(F.col("sum"), F.col("n")).alias("mean_monthly"),
        F.round(sd_cents / F.lit(100.0), 2).alias("stddev_monthly"),
    )


def q5f_moving_avg(star: Star, window: int = 3) -> DataFrame:
    f = _fact(star)
    per = f.groupBy("tenure_months").agg(n_rows().alias("customers"), sum_cents("monthly_charges").alias("_mrr"))
    per = per.withColumn("_avg_c", round_units(F.col("_mrr"), F.col("customers"), 1))
    w = Window.orderBy("tenure_months").rowsBetween(-(window - 1), Window.currentRow)  # <= 73 rows
    return per.select(
        "tenure_months", "customers",
        scaled(F.col("_avg_c"), 2).alias("avg_monthly_charges"),
        scaled(round_units(F.sum("_avg_c").over(w), F.count("_avg_c").over(w), 1), 2).alias("moving_avg_3m"),
    ).orderBy("tenure_months")


# --- section 6: CTE reports -------------------------------------------------------------


def risk_profile_rows(star: Star, tiles: int = 5) -> DataFrame:
    """Per-customer value quintile (NTILE over everybody) and q6a risk label."""
    f = _fact(star).select(
        "customer_id", "tenure_months", "monthly_charges", "is_churned", "mrr_at_risk",
        "contract_type", "total_addons", "is_new_customer",
    )
    numbered = ntile_column(f, "monthly_charges", "customer_id", tiles, name="_q")
    q = F.col("_q")
    m2m = F.col("contract_type") == R.MONTH_TO_MONTH
    label = (
        F.when(F.col("is_churned"), F.lit("Churned"))
        .when(m2m & F.col("is_new_customer") & (q <= 2), F.lit("High Risk"))
        .when(m2m & F.col("is_new_customer"), F.lit("Medium Risk"))
        .when((F.col("contract_type") != R.MONTH_TO_MONTH) & (q == 1), F.lit("High Value"))
        .otherwise(F.lit("Stable"))
    )
    return numbered.select("*", q.alias("value_quintile"), label.alias("risk_segment")).drop("_q")


def q6a_risk_profile(star: Star, tiles: int = 5) -> DataFrame:
    rows = risk_profile_rows(star, tiles)
    agg = rows.groupBy("risk_segment").agg(
        n_rows().alias("_n"),
        sum_cents("monthly_charges").alias("_mrr"),
        F.sum("tenure_months").alias("_tenure"),
        F.sum("total_addons").alias("_addons"),
        sum_cents("mrr_at_risk").alias("_risk"),
    )
    return agg.select(
        "risk_segment",
        F.col("_n").alias("customers"),
        avg_money(F.col("_mrr"), F.col("_n")).alias("avg_monthly_charges"),
        money(F.col("_mrr")).alias("total_mrr"),
        ratio(F.col("_tenure"), F.col("_n"), 1).alias("avg_tenure"),
        ratio(F.col("_addons"), F.col("_n"), 1).alias("avg_addons"),
        money(F.col("_risk")).alias("mrr_at_risk"),
    ).orderBy(F.desc("total_mrr"))


def q6b_top_segments(star: Star, top: int = 10) -> DataFrame:
    seg = ["contract_type", "internet_tier", "payment_category"]
    s = summarize(
        _fact(star), seg,
        ["customers", "total_mrr", "avg_monthly", "churned", "churn_rate_pct", "mrr_at_risk"],
    )
    w = Window.orderBy(F.desc("total_mrr"), *seg)  # over the segment table (<= a few dozen rows)
    return (
        s.withColumn("revenue_rank", F.row_number().over(w).cast("long"))
        .where(F.col("revenue_rank") <= top)
        .select("revenue_rank", *seg, "customers", "total_mrr", "avg_monthly", "churned", "churn_rate_pct", "mrr_at_risk")
        .orderBy("revenue_rank")
    )


def q6c_cohort_risk(star: Star) -> DataFrame:
    f = _fact(star)
    clv = F.col("estimated_clv")
    c = f.groupBy("tenure_bucket").agg(
        F.min("tenure_months").alias("_sort"),
        n_rows().alias("total_customers"),
        n_churned().alias("churned_customers"),
        sum_cents("monthly_charges").alias("_mrr"),
        sum_cents("mrr_at_risk").alias("_risk"),
        F.sum(cents(clv)).alias("_clv"),
        F.count(clv).alias("_clv_n"),
    )
    return c.select(
        "tenure_bucket", "total_customers", "churned_customers",
        pct(F.col("churned_customers"), F.col("total_customers")).alias("churn_rate_pct"),
        money(F.col("_mrr")).alias("total_mrr"),
        money(F.col("_risk")).alias("mrr_at_risk"),
        pct(F.col("_risk"), F.sum("_risk").over(Window.partitionBy())).alias("pct_of_total_risk"),
        avg_money(F.col("_clv"), F.col("_clv_n")).alias("avg_clv"),
        "_sort",
    ).orderBy("_sort").drop("_sort")


# --- fixed values: services compared in the stickiness report, with their labels
STICKINESS_SERVICES = [
    ("Tech Support", "tech_support"),
    ("Online Security", "online_security"),
    ("Online Backup", "online_backup"),
    ("Device Protection", "device_protection"),
]


def unpivot_services(df: DataFrame, services: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """One row per (customer, service): a single pass with ``stack`` instead of
    one scan of the fact per service."""
    args = ", ".join(f"'{label}', `{col}`" for label, col in services)
    return df.select(*keep, F.expr(f"stack({len(services)}, {args}) AS (service_name, subscribed)"))


def q6d_service_stickiness(star: Star) -> DataFrame:
    long = unpivot_services(_fact(star), STICKINESS_SERVICES, ["is_churned"])
    return summarize(long, ["service_name", "subscribed"], ["customers", "churn_rate_pct"]).orderBy(
        "service_name", "subscribed"
    )


ANALYSES = {
    "q1a_kpi_topline": q1a_kpi_topline,
    "q1b_mrr_at_risk_pct": q1b_mrr_at_risk_pct,
    "q2a_churn_by_contract": q2a_churn_by_contract,
    "q2b_churn_by_internet": q2b_churn_by_internet,
    "q2c_churn_by_payment": q2c_churn_by_payment,
    "q2d_churn_by_tenure": q2d_churn_by_tenure,
    "q2e_churn_by_senior": q2e_churn_by_senior,
    "q2f_churn_by_addons": q2f_churn_by_addons,
    "q2g_churn_contract_internet": q2g_churn_contract_internet,
    "q3a_revenue_by_contract": q3a_revenue_by_contract,
    "q3b_revenue_by_tier": q3b_revenue_by_tier,
    "q3c_revenue_by_payment_category": q3c_revenue_by_payment_category,
    "q3d_clv_by_contract": q3d_clv_by_contract,
    "q4a_high_value_active": q4a_high_value_active,
    "q4b_at_risk_customers": q4b_at_risk_customers,
    "q4c_household_summary": q4c_household_summary,
    "q5a_clv_rank_in_contract": q5a_clv_rank_in_contract,
    "q5b_charge_rank": q5b_charge_rank,
    "q5c_running_mrr": q5c_running_mrr,
    "q5d_bucket_lag_lead": q5d_bucket_lag_lead,
    "q5e_charge_percentiles": q5e_charge_percentiles,
    "q5f_moving_avg": q5f_moving_avg,
    "q6a_risk_profile": q6a_risk_profile,
    "q6b_top_segments": q6b_top_segments,
    "q6c_cohort_risk": q6c_cohort_risk,
    "q6d_service_stickiness": q6d_service_stickiness,
}
