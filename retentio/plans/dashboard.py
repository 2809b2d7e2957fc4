"""Datasets behind the six-tab retention dashboard.

The dashboard text leaves some definitions open; they are explicit
parameters here, with the defaults stated:

* risk tiers (``db_risk_tiers``): Churned; High = active, month-to-month,
  tenure <= ``high_max_tenure``; Medium = other active month-to-month;
  Low = every other active customer;
* service lift: 'No internet service' / 'No phone service' count as not
  subscribed (``no_service_counts_as_no``);
* adoption denominator: all customers, or only those eligible for the service;
* upsell ranking: services below ``max_adoption_pct`` ranked by churn lift;
* retention priority: Priority 1 = the top ``priority_share`` of the active
  high-risk group by monthly charge (distributed row number, no cap on rows).

Every additive dataset is written over cells (``plans/cube.py``): its first
argument is a star, whose fact is scanned, or a cube, whose stored partial sums
are rolled up; both give the same rows under any filters.  Only the retention
list and a ``priority`` filter, which rank customers, need the star.

``mrr_at_risk`` of the fact is revenue already lost; revenue of active
high-risk customers is named ``recoverable_mrr``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import avg_money, cents, idiv, money, pct, ratio, round_units, scaled
from ..operators.ordering import row_numbers, running_totals
from .cube import DASHBOARD_SERVICES, HIGH_MAX_TENURE, cells_of, charges_of, risk_tier  # noqa: F401
from .star import Star
from .stats import contingency


def _cells(source, filters: dict[str, object] | None = None, high_max_tenure: int = HIGH_MAX_TENURE) -> DataFrame:
    return apply_filters(cells_of(source, high_max_tenure), filters)


def total(measure: str, where: Column | None = None) -> Column:
    """A measure summed over cells; 0 where there are none."""
    cell = F.col(measure) if where is None else F.when(where, F.col(measure))
    return F.coalesce(F.sum(cell), F.lit(0).cast("bigint"))


def apply_filters(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Dashboard filters: column → value or list of values (AND across columns).
    ``priority`` (a place among the high-risk rows) is for the retention datasets
    and must be absent here."""
    for col, val in (filters or {}).items():
        vals = list(val) if isinstance(val, (list, tuple, set)) else [val]
        df = df.where(F.col(col).isin(vals))
    return df


def db_overview_kpis(source, filters=None) -> DataFrame:
    a = _cells(source, filters).agg(*[total(m).alias(m) for m in ("customers", "churned", "clv_n")],
                                    *[F.sum(m).alias(m) for m in ("mrr", "clv", "tenure")],
                                    F.sum(F.when(F.col("churned") > 0, F.col("risk"))).alias("risk"))
    return a.select(
        "customers", pct(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
        money(F.col("mrr")).alias("total_mrr"), money(F.col("risk")).alias("mrr_at_risk"),
        avg_money(F.col("clv"), F.col("clv_n")).alias("avg_clv"),
        ratio(F.col("tenure"), F.col("customers"), 1).alias("avg_tenure_months"),
    )


def db_risk_share_by_contract(source, filters=None) -> DataFrame:
    g = _cells(source, filters).groupBy("contract_type").agg(F.sum(F.when(F.col("churned") > 0, F.col("risk"))).alias("risk"))
    whole = F.sum("risk").over(Window.partitionBy())  # a few contract types
    return g.select(
        "contract_type", money(F.col("risk")).alias("mrr_at_risk"), pct(F.col("risk"), whole).alias("share_pct")
    ).orderBy(F.desc("mrr_at_risk"))


def _by_each(cells: DataFrame, dimensions: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Measures by the values of each dimension: dimension, value, …"""
    args = ", ".join(f"'{d}', `{d}`" for d in dimensions)
    long = cells.select(*measures, F.expr(f"stack({len(dimensions)}, {args}) AS (dimension, value)"))
    return long.groupBy("dimension", "value").agg(*[F.sum(m).alias(m) for m in measures])


def db_vs_average(source, dimensions: tuple[str, ...] = ("contract_type", "internet_service", "payment_method",
                                                         "tenure_bucket"), filters=None) -> DataFrame:
    """Group churn rate against the overall rate (the reference line)."""
    cells = _cells(source, filters)
    g = _by_each(cells, dimensions, ("customers", "churned"))
    # the reference line: overall customers and churned, as scalar subqueries
    n_all, c_all = cells.agg(total("customers")).scalar(), cells.agg(total("churned")).scalar()
    return g.withColumns({"_n": n_all, "_c": c_all}).select(
        "dimension", "value", "customers", pct(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
        pct(F.col("_c"), F.col("_n")).alias("overall_rate_pct"),
        (F.col("churned") * F.col("_n") > F.col("_c") * F.col("customers")).alias("above_average"),
    ).orderBy("dimension", "value")


def db_crosstab(source, filters=None) -> DataFrame:
    """Contract × internet churn rates, whatever the values are, each with the rates of its row, its column and all."""
    grid = contingency(_cells(source, filters), "contract_type", "internet_service", ("customers", "churned"))
    rates = [pct(F.col(f"{p}churned"), F.col(f"{p}customers")).alias(f"{name}churn_rate_pct")
             for p, name in (("", ""), ("row_", "contract_"), ("col_", "internet_"), ("all_", "overall_"))]
    return grid.select(F.col("row_value").alias("contract_type"), F.col("col_value").alias("internet_service"), "customers",
                       "churned", *rates).orderBy("contract_type", "internet_service")


def db_filtered(source, filters: dict[str, object] | None = None, by: tuple[str, ...] = ("contract_type",)) -> DataFrame:
    """Any churn summary under dashboard filters, composed before the groupBy."""
    g = _cells(source, filters).groupBy(*by).agg(*[F.sum(m).alias(m) for m in ("customers", "churned", "mrr")])
    return g.select(*by, F.col("customers").alias("total_customers"), "churned",
                    pct(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
                    avg_money(F.col("mrr"), F.col("customers")).alias("avg_monthly_charges"),
                    money(F.col("mrr")).alias("total_mrr")).orderBy(*by)


def db_mrr_split(source, filters=None) -> DataFrame:
    gone = F.col("risk_tier") == "Churned"
    cells = _cells(source, filters).withColumns({
        "kept": F.when(gone, 0).otherwise(F.col("mrr")), "lost": F.when(gone, F.col("mrr")).otherwise(0)})
    return _by_each(cells, ("contract_type", "internet_tier"), ("kept", "lost")).select(
        "dimension", "value", money(F.col("kept")).alias("retained_mrr"), money(F.col("lost")).alias("churned_mrr"),
    ).orderBy("dimension", "value")


def db_clv_projection(source, filters=None) -> DataFrame:
    """Dashboard CLV = average monthly charge × average tenure (per group)."""
    g = _by_each(_cells(source, filters), ("contract_type", "internet_tier"), ("customers", "mrr", "tenure"))
    n = F.col("customers").cast("decimal(38,0)")
    return g.select(
        "dimension", "value", avg_money(F.col("mrr"), F.col("customers")).alias("avg_monthly_charges"),
        ratio(F.col("tenure"), F.col("customers"), 1).alias("avg_tenure_months"),
        scaled(round_units(F.col("mrr").cast("decimal(38,0)") * F.col("tenure"), n * n, 1), 2).alias("projected_clv"),
    ).orderBy("dimension", "value")


def db_charge_distribution(source, bin_width: float = 10.0, filters=None) -> DataFrame:
    """Customers and revenue per charge bin with cumulative revenue share."""
    w_c = int(round(bin_width * 100))
    g = apply_filters(charges_of(source, w_c), filters).groupBy("lo").agg(
        F.sum("customers").alias("customers"), F.sum("mrr").alias("_rev"))
    # running revenue over the bins; the bin count follows the charge range, so
    # the running totals use the counted small-or-distributed operator
    run = running_totals(g, [F.col("lo").asc()], {"_run": "_rev"})
    whole = F.col("_run_total")
    return run.select(
        money(F.col("lo")).alias("bin_lo"), money(F.col("lo") + w_c).alias("bin_hi"), "customers",
        money(F.col("_rev")).alias("mrr"), pct(F.col("_rev"), whole).alias("revenue_share_pct"),
        pct(F.col("_run"), whole).alias("cumulative_share_pct"),
    ).orderBy("bin_lo")


def db_risk_tiers(source, high_max_tenure: int = HIGH_MAX_TENURE, filters=None) -> DataFrame:
    g = _cells(source, filters, high_max_tenure).groupBy("risk_tier").agg(
        F.sum("customers").alias("customers"), F.sum("mrr").alias("mrr"))
    whole = F.sum("customers").over(Window.partitionBy())  # four tiers
    return g.select(
        "risk_tier", "customers", pct(F.col("customers"), whole).alias("pct_of_customers"),
        money(F.col("mrr")).alias("total_mrr"),
    ).orderBy("risk_tier")


def db_segment_table(source, filters: dict[str, object] | None = None) -> DataFrame:
    g = _by_each(_cells(source, filters), ("household_type", "senior_segment", "addon_group"), ("customers", "churned", "mrr"))
    return g.select(F.col("dimension").alias("segment_type"), F.col("value").alias("segment"), "customers",
                    pct(F.col("churned"), F.col("customers")).alias("churn_rate_pct"), money(F.col("mrr")).alias("total_mrr"),
                    ).orderBy("segment_type", "segment")


def _service_counts(source, no_service_counts_as_no: bool = True, eligible_only: bool = False, filters=None) -> DataFrame:
    """Subscribers, others and churners of both per service: one pass for lift and adoption."""
    kinds = ("yes", "yes_churned", "no", "no_churned", "none")
    cells = _cells(source, filters)
    sums = cells.agg(*[F.sum(m).alias(m) for m in ("customers", "churned")],
                     *[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for _, c in DASHBOARD_SERVICES for k in kinds]).where("customers > 0")
    args = ", ".join(f"'{label}', " + ", ".join(f"{c}_{k}" for k in kinds) for label, c in DASHBOARD_SERVICES)
    each = sums.select("customers", "churned", F.expr(f"stack({len(DASHBOARD_SERVICES)}, {args}) AS (service_name, {', '.join(kinds)})"))
    non, gone = ((F.col("customers") - F.col("yes"), F.col("churned") - F.col("yes_churned")) if no_service_counts_as_no
                 else (F.col("no"), F.col("no_churned")))
    base = F.col("customers") - F.col("none") if eligible_only else F.col("customers")
    return each.select("service_name", F.col("yes").alias("subscribers"), F.col("yes_churned").alias("_sc"),
                       non.alias("non_subscribers"), gone.alias("_nc"), base.alias("base"))


def _lift() -> tuple[Column, Column, Column]:
    su = round_units(F.col("_sc"), F.col("subscribers"), 10000)
    nu = round_units(F.col("_nc"), F.col("non_subscribers"), 10000)
    return (scaled(su, 2).alias("subscriber_churn_pct"), scaled(nu, 2).alias("non_subscriber_churn_pct"),
            scaled(nu - su, 2).alias("churn_lift_pct"))


def db_service_lift(source, no_service_counts_as_no: bool = True, filters=None) -> DataFrame:
    g = _service_counts(source, no_service_counts_as_no, filters=filters)
    return g.select("service_name", "subscribers", "non_subscribers", *_lift()).orderBy("service_name")


def _adoption() -> Column:
    return pct(F.col("subscribers"), F.col("base")).alias("adoption_pct")


def db_adoption(source, eligible_only: bool = False, filters=None) -> DataFrame:
    g = _service_counts(source, eligible_only=eligible_only, filters=filters)
    return g.select("service_name", F.col("subscribers").alias("adopters"), "base", _adoption()).orderBy("service_name")


def db_price_by_tier_contract(source, filters=None) -> DataFrame:
    g = _cells(source, filters).groupBy("internet_tier", "contract_type").agg(
        F.sum("customers").alias("customers"), F.sum("mrr").alias("mrr"))
    return g.select("internet_tier", "contract_type", "customers",
                    avg_money(F.col("mrr"), F.col("customers")).alias("avg_monthly_charges")).orderBy("internet_tier", "contract_type")


def db_upsell_candidates(source, max_adoption_pct: float = 50.0, filters=None) -> DataFrame:
    g = _service_counts(source, filters=filters).select("service_name", _adoption(), _lift()[2])
    j = g.where(F.col("adoption_pct") < max_adoption_pct)
    w = Window.orderBy(F.desc("churn_lift_pct"), "adoption_pct", "service_name")  # at most 8 services
    return j.select("*", F.row_number().over(w).cast("long").alias("upsell_rank")).orderBy("upsell_rank")


def _priority_cut(n: Column, priority_share: float) -> Column:
    return idiv(n * int(round(priority_share * 10000)) + 9999, F.lit(10000))  # ceil(n · share)


def _high_risk(source, high_max_tenure: int, filters: dict[str, object] | None) -> DataFrame:
    rows = {k: v for k, v in (filters or {}).items() if k != "priority"}
    return _cells(source, rows, high_max_tenure).where(F.col("risk_tier") == "High Risk")


def retention_rows(star: Star, high_max_tenure: int = HIGH_MAX_TENURE, priority_share: float = 0.13, filters=None) -> DataFrame:
    """Active high-risk customers with charge rank and priority (1 = top share).
    A ``priority`` filter picks from the ranked rows, the others apply before ranking."""
    f = _high_risk(star, high_max_tenure, filters).select(
        "customer_id", "contract_type", "internet_service", "payment_method", "tenure_months", "monthly_charges",
        "senior_citizen",
    )
    ranked = row_numbers(f, [F.col("monthly_charges").desc(), F.col("customer_id").asc()], rn="charge_rank", size="_n")
    ranked = ranked.select(
        "*", F.when(F.col("charge_rank") <= _priority_cut(F.col("_n"), priority_share), F.lit(1)).otherwise(F.lit(2)).alias("priority")
    ).drop("_n")
    return apply_filters(ranked, {k: v for k, v in (filters or {}).items() if k == "priority"})


def db_retention_list(star: Star, high_max_tenure: int = 12, priority_share: float = 0.13, filters=None) -> DataFrame:
    r = retention_rows(star, high_max_tenure, priority_share, filters)
    return r.select(
        "customer_id", "contract_type", "internet_service", "payment_method", "tenure_months",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        F.col("charge_rank").cast("long").alias("charge_rank"), "priority",
    ).orderBy("charge_rank")


def db_recoverable_mrr(source, high_max_tenure: int = HIGH_MAX_TENURE, priority_share: float = 0.13,
                       retention_success: float = 1.0, filters=None) -> DataFrame:
    """Sums over the high-risk group; no row is ranked, the number of first-priority
    customers follows from the group's size.  (With a ``priority`` filter the rows are.)"""
    if "priority" in (filters or {}):
        r = retention_rows(source, high_max_tenure, priority_share, filters).withColumns({
            "customers": F.lit(1).cast("bigint"), "tenure": F.col("tenure_months").cast("bigint"), "mrr": cents(F.col("monthly_charges"))})
        first = F.count_if(F.col("priority") == 1)
    else:
        r = _high_risk(source, high_max_tenure, filters)
        first = _priority_cut(total("customers"), priority_share)
    a = r.agg(
        total("customers").alias("high_risk_customers"), first.cast("bigint").alias("priority1_customers"),
        F.sum("tenure").alias("_t"), F.sum("mrr").alias("_c"),
    )
    success_bp = int(round(retention_success * 10000))
    return a.select(
        "high_risk_customers", "priority1_customers",
        ratio(F.col("_t"), F.col("high_risk_customers"), 1).alias("avg_tenure_months"),
        money(F.col("_c")).alias("high_risk_mrr"),
        scaled(round_units(F.col("_c") * success_bp, F.lit(10000), 1), 2).alias("recoverable_mrr"),
    )


DASHBOARD = {
    "db_overview_kpis": db_overview_kpis,
    "db_risk_share_by_contract": db_risk_share_by_contract,
    "db_vs_average": db_vs_average,
    "db_crosstab": db_crosstab,
    "db_filtered": lambda star: db_filtered(star, {"dependents": "No", "partner": "No"}),
    "db_mrr_split": db_mrr_split,
    "db_clv_projection": db_clv_projection,
    "db_charge_distribution": db_charge_distribution,
    "db_risk_tiers": db_risk_tiers,
    "db_segment_table": db_segment_table,
    "db_service_lift": db_service_lift,
    "db_adoption": db_adoption,
    "db_price_by_tier_contract": db_price_by_tier_contract,
    "db_upsell_candidates": db_upsell_candidates,
    "db_retention_list": db_retention_list,
    "db_recoverable_mrr": db_recoverable_mrr,
    # one dataset of each tab under that tab's filters, from the cube where it is additive
    "db_overview_filtered": lambda star: db_overview_kpis(star.cube, filters={"senior_citizen": "Yes"}),
    "db_revenue_filtered": lambda star: db_mrr_split(star.cube, filters={"contract_type": ["One year", "Two year"]}),
    "db_risk_filtered": lambda star: db_crosstab(star.cube, filters={"risk_tier": ["Medium Risk", "Churned"]}),
    "db_services_filtered": lambda star: db_adoption(star.cube, filters={"internet_tier": "Fiber Optic"}),
    "db_cube_segments": lambda star: db_segment_table(star.cube, filters={
        "gender": "Female", "contract_type": ["Month-to-month", "Two year"], "internet_tier": ["DSL", "No Internet"],
        "tenure_bucket": ["0-12 months", "25-36 months", "61+ months"], "payment_category": "Manual"}),
    "db_cube_charges": lambda star: db_charge_distribution(star.cube, filters={
        "senior_citizen": "No", "partner": "Yes", "risk_tier": ["Low Risk", "Medium Risk"]}),
    "db_retention_filtered": lambda star: db_retention_list(star, filters={"priority": 1, "internet_service": "DSL"}),
}
