"""Physical-plan properties the scale design relies on."""

from __future__ import annotations

import os
import re

import pytest

from retentio.plans import analytics as A
from retentio.registry import pipeline
from retentio.sources.subscribers import derive_raw

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lineitem_scan_is_pruned_and_reads_every_row(spark):
    plan = _plan(derive_raw(spark, SF))
    li = [line for line in plan.splitlines() if "lineitem" in line and "FileScan" in line]
    assert li, plan
    assert "EqualTo" not in li[0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in li[0]


def test_reports_scan_only_their_columns(spark):
    star = pipeline(spark, SF).star
    plan = _plan(A.q2a_churn_by_contract(star))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "Join" not in plan
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scans[0]).group(1)
    assert sorted(c.split("#")[0] for c in cols.split(",")) == ["contract_type", "is_churned", "monthly_charges", "mrr_at_risk"]


def test_quintiles_do_not_move_the_fact(spark):
    star = pipeline(spark, SF).star
    plan = _plan(A.q6a_risk_profile(star))
    main = plan.split("Subquery")[0]  # the boundaries arrive as a scalar subquery
    exchanges = [line.strip() for line in main.splitlines() if "Exchange" in line]
    assert all("hashpartitioning(risk_segment" in e or "rangepartitioning(total_mrr" in e for e in exchanges), exchanges
    assert "SinglePartition" not in main


def test_rank_limit_is_pushed_below_the_shuffle(spark):
    star = pipeline(spark, SF).star
    df = A.q5a_clv_rank_in_contract(star)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_charge_rank_is_a_top_k(spark):
    star = pipeline(spark, SF).star
    plan = _plan(A.q5b_charge_rank(star))
    assert "TakeOrderedAndProject" in plan
    # the only windows run above the 20-row top-k, never over the fact
    below_topk = plan.split("TakeOrderedAndProject", 1)[1]
    assert "Window" not in below_topk


def _scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan")


def test_audits_scan_each_table_once(spark):
    from retentio.plans import profile as P
    from retentio.plans import quality as Q

    p = pipeline(spark, SF)
    star = p.star
    assert _scans(Q.dq_domain(p.staging)) == _scans(Q.dq_whitespace(p.staging)) == 1
    assert _scans(Q.dq_nulls(p.raw, p.staging)) == 2
    assert _scans(Q.dq_row_counts(p.raw, p.staging, star)) <= 7  # the counted tables
    assert _scans(P.prof_duplicates(p.raw)) == 1
    assert _scans(p.quarantine) == 1


def test_one_pass_datasets(spark):
    from retentio.plans import dashboard as D

    star = pipeline(spark, SF).star
    for df in (D.db_upsell_candidates(star), D.db_recoverable_mrr(star)):
        assert _scans(df) == 1 and "rangepartitioning" not in df.select("*")._jdf.queryExecution().optimizedPlan().toString()


def test_a_side_as_long_as_the_input_is_never_broadcast(spark):
    from retentio.operators.joins import broadcast_or_merge
    from retentio.plans import quality as Q

    few, many = spark.range(9), spark.range(60)
    for join in (many.join(broadcast_or_merge(few, max_rows=8), "id"), many.join(broadcast_or_merge(few, max_bytes=70), "id")):
        assert "SortMergeJoin" in _plan(join) and "BroadcastHashJoin" not in _plan(join) and join.count() == 9
    assert "BroadcastHashJoin" in _plan(many.join(broadcast_or_merge(few), "id"))

    star = pipeline(spark, SF).star  # Spark estimates both at a few KB here
    keys = [line for line in _plan(Q.dq_orphans(star.fact, Q.star_dims(star))).splitlines() if "LeftOuter" in line and "customer_key" in line]
    assert keys and all("SortMergeJoin" in k for k in keys)
    orders = [line for line in _plan(derive_raw(spark, SF)).splitlines() if "Join" in line and "l_orderkey" in line]
    assert orders and all("SortMergeJoin" in o for o in orders)


def test_stored_customers_are_not_broadcast_unmeasured(spark, monkeypatch):
    from retentio.operators import joins
    from retentio.plans import warehouse

    star = pipeline(spark, SF).star
    stored = warehouse.StoredStar({**star.tables(), "staging": star.staging})
    monkeypatch.setattr(warehouse, "broadcast_or_merge", lambda df: joins.broadcast_or_merge(df, max_rows=500))  # shorter than the customers
    df = A.q6a_risk_profile(stored)
    lines = [line for line in _plan(df).splitlines() if "Join" in line and "customer_key" in line]
    assert lines and all("SortMergeJoin" in x for x in lines)
    assert sorted(map(str, df.collect())) == sorted(map(str, A.q6a_risk_profile(star).collect()))
