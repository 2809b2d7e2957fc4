"""Dashboard datasets on a hand-made star: risk tiers, lift, adoption,
retention priority, recoverable revenue."""

from __future__ import annotations

import pytest

from retentio.plans import dashboard as D
from retentio.plans.pipeline import Pipeline

from .conftest import raw_rows


@pytest.fixture(scope="module")
def star(spark):
    rows = []
    # 10 active new month-to-month customers with distinct charges → High Risk
    for i in range(10):
        rows.append({"customerid": f"H{i:02d}", "tenure": str(1 + i), "monthlycharges": f"{50 + i}.00",
                     "techsupport": "Yes" if i < 3 else "No"})
    rows += [
        {"customerid": "M1", "tenure": "30", "monthlycharges": "40.00"},  # Medium: m2m, long tenure
        {"customerid": "L1", "tenure": "30", "contract": "Two year", "monthlycharges": "80.00"},
        {"customerid": "C1", "tenure": "5", "churn": "Yes", "monthlycharges": "70.00", "techsupport": "Yes"},
        {"customerid": "N1", "tenure": "20", "internetservice": "No", "techsupport": "No internet service",
         "onlinesecurity": "No internet service", "onlinebackup": "No internet service",
         "deviceprotection": "No internet service", "streamingtv": "No internet service",
         "streamingmovies": "No internet service", "contract": "One year"},
    ]
    return Pipeline(spark, raw=raw_rows(spark, rows)).star


def test_risk_tiers(star):
    t = {r.risk_tier: r.customers for r in D.db_risk_tiers(star).collect()}
    assert t == {"High Risk": 10, "Medium Risk": 1, "Low Risk": 2, "Churned": 1}


def test_retention_priority_and_recoverable(star):
    lst = D.db_retention_list(star, priority_share=0.25).collect()
    assert [r.customer_id for r in lst[:3]] == ["H09", "H08", "H07"]
    assert [r.priority for r in lst].count(1) == 3  # ceil(10 × 0.25)
    rec = D.db_recoverable_mrr(star, priority_share=0.25, retention_success=0.5).first()
    assert rec.high_risk_customers == 10 and rec.priority1_customers == 3
    assert rec.high_risk_mrr == sum(50 + i for i in range(10))
    assert rec.recoverable_mrr == sum(50 + i for i in range(10)) / 2


def test_service_lift_and_adoption(star):
    lift = {r.service_name: r for r in D.db_service_lift(star).collect()}
    ts = lift["Tech Support"]
    # subscribers: H00-H02 and C1 (churned) → 1/4; non-subscribers 10, none churned
    assert (ts.subscribers, ts.non_subscribers, ts.subscriber_churn_pct, ts.non_subscriber_churn_pct) == (4, 10, 25.0, 0.0)
    eligible = {r.service_name: r for r in D.db_adoption(star, eligible_only=True).collect()}
    everyone = {r.service_name: r for r in D.db_adoption(star).collect()}
    assert everyone["Tech Support"].base == 14 and eligible["Tech Support"].base == 13


def test_vs_average_and_crosstab(star):
    v = {(r.dimension, r.value): r for r in D.db_vs_average(star).collect()}
    assert v[("contract_type", "Month-to-month")].above_average  # 1 churned of 12 vs 1 of 14
    x = {(r.contract_type, r.internet_service): r for r in D.db_crosstab(star).collect()}
    assert x["One year", "No"].churn_rate_pct == 0.0
    assert (x["One year", "DSL"].customers, x["One year", "DSL"].churn_rate_pct) == (0, None)
    assert len(x) == 6 and all(r.overall_churn_rate_pct == 7.14 for r in x.values())


def test_an_unknown_internet_service_is_a_column_of_its_own(spark):
    rows = [{"customerid": "A"}, {"customerid": "B", "internetservice": "Satellite", "churn": "Yes"},
            {"customerid": "C", "internetservice": "Satellite", "contract": "Two year"}]
    star = Pipeline(spark, raw=raw_rows(spark, rows)).star
    x = {(r.contract_type, r.internet_service): r for r in D.db_crosstab(star.cube).collect()}
    assert set(x) == {(c, i) for c in ("Month-to-month", "Two year") for i in ("DSL", "Satellite")}
    r = x["Month-to-month", "Satellite"]
    assert (r.customers, r.churn_rate_pct, r.contract_churn_rate_pct, r.internet_churn_rate_pct, r.overall_churn_rate_pct) == (
        1, 100.0, 50.0, 50.0, 33.33)


ADDITIVE = [D.db_overview_kpis, D.db_risk_share_by_contract, D.db_vs_average, D.db_crosstab, D.db_filtered, D.db_mrr_split,
            D.db_clv_projection, D.db_charge_distribution, D.db_risk_tiers, D.db_segment_table, D.db_service_lift, D.db_adoption,
            D.db_price_by_tier_contract, D.db_upsell_candidates, D.db_recoverable_mrr]
FILTERS = [
    {"household_type": "Family", "risk_tier": ["Low Risk", "Churned"], "senior_segment": "Non-Senior", "internet_tier": ["DSL", "Fiber Optic"],
     "tenure_bucket": ["0-12 months", "61+ months"], "payment_category": "Automatic"},
    {"payment_method": "no such method"},
]


def test_every_additive_dataset_from_the_cube_equals_the_fact_scan(spark, capsys):
    from retentio.registry import pipeline

    star = pipeline(spark, "/root/testdata/sf0.001").star
    assert star.cube.stored_cells.count() < star.fact.count()
    for dataset in ADDITIVE:
        for filters in FILTERS:
            cube, fact = dataset(star.cube, filters=filters), dataset(star, filters=filters)
            assert cube.schema.simpleString() == fact.schema.simpleString()
            assert sorted(map(str, cube.collect())) == sorted(map(str, fact.collect())), (dataset.__name__, filters)
        assert not set(star.fact_enriched.inputFiles()) & set(cube.inputFiles())


def test_cells_of_two_loads_merge(spark):
    from pyspark.sql import functions as F

    from retentio.plans import cube as C
    from retentio.registry import pipeline

    star = pipeline(spark, "/root/testdata/sf0.001").star
    cells = C.unit_cells(star.fact_enriched)
    by = [*C.FILTER_DIMENSIONS, "addon_group"]
    halves = [cells.where(F.pmod(F.xxhash64("customer_id"), F.lit(2)) == i).groupBy(*by).agg(*[F.sum(m).alias(m) for m in C.MEASURES])
              for i in (0, 1)]
    merged = C.Cube(cells=halves[0].unionByName(halves[1]))
    assert sorted(map(str, D.db_overview_kpis(merged).collect())) == sorted(map(str, D.db_overview_kpis(star).collect()))
    with pytest.raises(ValueError):
        D.db_risk_tiers(star.cube, high_max_tenure=6)
    with pytest.raises(ValueError):
        D.db_charge_distribution(star.cube, bin_width=7.0)
