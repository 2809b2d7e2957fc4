"""Hand-made cases the derived fixture lacks: dirty rows, unknown categories,
tenure edges, tenure outside the dimension, ties, NULL CLV, gaps, buckets
without churn."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retentio.plans import analytics as A
from retentio.plans import quality as Q
from retentio.plans.pipeline import Pipeline
from retentio.plans.pipeline import open_warehouse
from retentio.plans.staging import check_raw, stg_clean, stg_quarantine

from .conftest import raw_rows


def test_quarantine_reasons(spark):
    raw = raw_rows(spark, [
        {"customerid": "A1", "seniorcitizen": "2"},
        {"customerid": " A2 ", "tenure": None},
        {"customerid": "A3", "monthlycharges": "abc"},
        {"customerid": "A4", "monthlycharges": "12345678901"},
        {"customerid": "A5", "gender": "\tFemale"},
        {"customerid": "A6"},
        {"customerid": "A6"},
        {"customerid": "A7", "totalcharges": " "},
        {"customerid": "A8", "totalcharges": "x1"},
    ])
    got = {r.customerid: r.reason for r in stg_quarantine(check_raw(raw)).collect()}
    assert got["A1"] == "senior_citizen: unknown code"
    assert "tenure_months: missing" in got[" A2 "]
    assert got["A3"] == "monthly_charges: not numeric(10,2)"
    assert got["A4"] == "monthly_charges: not numeric(10,2)"
    assert got["A6"] == "customer_id: duplicated 2 times"
    assert got["A8"] == "total_charges: not numeric(10,2)"
    assert "A7" not in got  # a blank total is a valid NULL
    assert "A5" not in got  # the tab survives TRIM but breaks no rule


def test_clean_is_strict(spark):
    raw = raw_rows(spark, [{"customerid": "B1", "monthlycharges": "abc"}])
    with pytest.raises(Exception):
        stg_clean(raw).collect()


def test_clean_types_and_blank(spark):
    raw = raw_rows(spark, [{"customerid": " B2 ", "seniorcitizen": "1", "tenure": "0", "totalcharges": " "}])
    r = stg_clean(raw).first()
    assert (r.customer_id, r.senior_citizen, r.tenure_months, r.total_charges) == ("B2", "Yes", 0, None)


def _pipeline(spark, rows):
    return Pipeline(spark, raw=raw_rows(spark, rows))


def test_unknown_categories_and_tenure_edges(spark):
    rows = [{"customerid": f"T{t:02d}", "tenure": str(t)} for t in [0, 1, 12, 13, 47, 48, 60, 61, 72, 73]]
    rows += [
        {"customerid": "U1", "contract": "Three year", "internetservice": "Satellite", "partner": "May"},
        {"customerid": "U2", "paymentmethod": "Bank transfer (AUTOMATIC)"},
    ]
    p = _pipeline(spark, rows)
    star = p.star
    t = {r.tenure_months: r for r in star.dim_tenure.collect()}
    assert [t[m].tenure_bucket for m in (0, 12, 13, 48, 60, 61, 72)] == [
        "0-12 months", "0-12 months", "13-24 months", "37-48 months", "49-60 months", "61+ months", "61+ months"]
    assert [t[m].tenure_year for m in (0, 1, 12, 13, 72)] == [1, 1, 1, 2, 6]
    assert t[12].is_new_customer and not t[13].is_new_customer and t[48].is_long_term and not t[47].is_long_term
    contract = {r.contract_type: r for r in star.dim_contract.collect()}
    assert contract["Three year"].contract_length == "Unknown"
    pay = {r.payment_method: r.payment_category for r in star.dim_contract.collect()}
    assert pay["Bank transfer (AUTOMATIC)"] == "Automatic"
    tiers = {r.internet_service: r.internet_tier for r in star.dim_service_plan.collect()}
    assert tiers["Satellite"] == "Unknown"
    cust = {r.customer_id: r for r in star.dim_customer.collect()}
    assert cust["U1"].household_type == "Unknown" and cust["U1"].senior_segment == "Non-Senior"
    # tenure 73 has no dimension row: the fact drops it and the row-count check reports it
    counts = {r.subject: r for r in Q.dq_row_counts(p.raw, p.staging, star).collect()}
    assert counts["fact_vs_staging"].observed == len(rows) - 1 and counts["fact_vs_staging"].ok is False
    assert all(r.observed == 0 for r in Q.dq_orphans(star.fact, Q.star_dims(star)).collect())
    # customer keys follow customer-id order
    keys = [r.customer_id for r in star.dim_customer.orderBy("customer_key").collect()]
    assert keys == sorted(keys)


def test_refused_rows_do_not_reach_the_star(spark):
    p = _pipeline(spark, [
        {"customerid": "C1"}, {"customerid": "C1"}, {"customerid": "C2", "seniorcitizen": "2"},
        {"customerid": "C3", "partner": None}, {"customerid": "C4"},
    ])
    assert [r.customer_id for r in p.star.fact.collect()] == ["C4"]
    assert [r.customer_id for r in p.star.dim_customer.collect()] == ["C4"]
    assert sorted(r.customerid for r in p.quarantine.collect()) == ["C1", "C1", "C2", "C3"]


def test_orphans_are_counted(spark):
    star = _pipeline(spark, [{"customerid": f"O{i}", "contract": c} for i, c in enumerate(["One year", "Two year", "One year"])]).star
    dims = Q.star_dims(star)
    gone = star.dim_contract.where("contract_type = 'One year'").first().contract_key
    dims["contract"] = dims["contract"].where(F.col("contract_key") != gone)
    dims["customer"] = dims["customer"].where("customer_id <> 'O1'")
    got = {r.subject: r.observed for r in Q.dq_orphans(star.fact, dims).collect()}
    assert got == {"orphan_customer": 1, "orphan_contract": 2, "orphan_service": 0, "orphan_date": 0}


def test_warehouse_is_replaced_and_reopened(spark, tmp_path):
    path = str(tmp_path / "wh")
    _pipeline(spark, [{"customerid": "W1"}, {"customerid": "W2"}]).write_warehouse(path)
    _pipeline(spark, [{"customerid": "W3"}, {"customerid": "W4", "seniorcitizen": "7"}]).write_warehouse(path)
    tables = open_warehouse(spark, path)
    assert [r.customer_id for r in tables["fact_subscription"].collect()] == ["W3"]
    assert [r.customerid for r in tables["quarantine"].collect()] == ["W4"]
    assert tables["staging"].count() == 1 and tables["raw"].count() == 2 and tables["dim_tenure"].count() == 73


def test_overwritten_inputs_give_new_answers(spark, tmp_path):
    import shutil

    from retentio.registry import queries

    for name in ("orders", "customer", "lineitem"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    shape = queries()["prof_shape"]
    first = shape(spark, str(tmp_path)).first().n_rows
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(tmp_path / "orders.parquet").slice(0, 100), tmp_path / "orders.parquet")
    assert first == 1500 and shape(spark, str(tmp_path)).first().n_rows == 100


def test_null_clv_ranks_first_and_ties(spark):
    rows = [{"customerid": f"N{i}", "tenure": "0", "totalcharges": " ", "monthlycharges": "10.00"} for i in range(3)]
    rows += [{"customerid": f"P{i:02d}", "tenure": "5", "monthlycharges": f"{20 + (i % 4)}.00",
              "totalcharges": "1.00"} for i in range(11)]
    p = _pipeline(spark, rows)
    top = A.q5a_clv_rank_in_contract(p.star).collect()
    assert [r.customer_id for r in top[:3]] == ["N0", "N1", "N2"]
    assert all(r.estimated_clv is None for r in top[:3])
    b = A.q5b_charge_rank(p.star).collect()
    # charges 23 ×2, 22 ×3, 21 ×3, 20 ×3, 10 ×3 (14 rows): RANK skips, DENSE_RANK does not
    assert [r.charge_rank for r in b[:6]] == [1, 1, 3, 3, 3, 6]
    assert [r.charge_dense_rank for r in b[:6]] == [1, 1, 2, 2, 2, 3]
    # NTILE(4) over 14 rows: sizes 4, 4, 3, 3
    quart = [r.charge_quartile for r in b]
    assert [quart.count(q) for q in (1, 2, 3, 4)] == [4, 4, 3, 3]
    k = A.q1a_kpi_topline(p.star).first()
    # NULL-CLV customers stay in the active denominator
    assert k.avg_clv_active == pytest.approx(round(sum(5 * (20 + i % 4) for i in range(11)) / 14, 2))


def test_gap_moving_average_and_bucket_without_churn(spark):
    rows = [
        {"customerid": "G1", "tenure": "1", "monthlycharges": "10.00"},
        {"customerid": "G2", "tenure": "2", "monthlycharges": "20.00"},
        {"customerid": "G3", "tenure": "5", "monthlycharges": "60.00", "churn": "Yes"},
    ]
    p = _pipeline(spark, rows)
    mv = [r.moving_avg_3m for r in A.q5f_moving_avg(p.star).collect()]
    assert mv == [10.0, 15.0, 30.0]  # rows, not calendar months
    c = {r.tenure_bucket: r for r in A.q6c_cohort_risk(p.star).collect()}
    assert c["0-12 months"].pct_of_total_risk == 100.0
    rows2 = [{"customerid": "H1", "tenure": "30"}]
    c2 = A.q6c_cohort_risk(_pipeline(spark, rows2).star).first()
    assert c2.mrr_at_risk is None and c2.pct_of_total_risk is None


def test_q4b_labels_against_average(spark):
    rows = [
        {"customerid": "R1", "tenure": "3", "monthlycharges": "90.00"},
        {"customerid": "R2", "tenure": "3", "monthlycharges": "10.00"},
        {"customerid": "R3", "tenure": "30", "monthlycharges": "50.00", "churn": "Yes"},
        {"customerid": "R4", "tenure": "30", "monthlycharges": "50.00", "contract": "Two year"},
    ]
    got = {r.customer_id: r.risk_segment for r in A.q4b_at_risk_customers(_pipeline(spark, rows).star).collect()}
    assert got == {"R1": "High Risk", "R2": "Medium Risk", "R3": "Churned"}


def test_clean_is_strict_without_ansi(spark):
    raw = raw_rows(spark, [{"customerid": "B3", "tenure": "ten"}])
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="tenure_months"):
            stg_clean(raw).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_rows_are_not_moved_to_find_repeated_ids(spark):
    from retentio.plans.staging import check_raw

    rows = [{"customerid": "C1"}, {"customerid": "C1", "tenure": "x"}, {"customerid": "C2", "partner": None, "seniorcitizen": None}, {"customerid": "C3"}]
    raw = raw_rows(spark, rows)
    Pipeline(spark, raw=raw)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"  # methods that HotSpot compiles
    checked = check_raw(raw)
    assert "hashpartitioning" not in checked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.customerid, r.reason) for r in checked.collect()) == [
        ("C1", "customer_id: duplicated 2 times"), ("C1", "tenure_months: not integer; customer_id: duplicated 2 times"),
        ("C2", "senior_citizen: missing; partner: missing"), ("C3", "")]
