"""Saved warehouses: versions, catalog, reconciliation, analyses over stored tables, declared constraints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retentio.plans import analytics, constraints, dashboard, warehouse
from retentio.plans.pipeline import WAREHOUSE_TABLES, Pipeline, open_warehouse

from .conftest import raw_rows


def _rows(n, **fixed):
    return [{"customerid": f"C{i:03d}", "tenure": str(i % 73), "contract": ("Month-to-month", "One year", "Two year")[i % 3],
             "churn": "Yes" if i % 4 == 0 else "No", "monthlycharges": f"{20 + i}.50", "totalcharges": f"{(20 + i) * (i % 73)}.00",
             "internetservice": ("DSL", "Fiber optic")[i % 2], **fixed} for i in range(n)]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warehouse"))
    pipeline = Pipeline(spark, raw=raw_rows(spark, _rows(60)))
    pipeline.write_warehouse(path)
    return pipeline, path


def _set(df):
    return sorted(map(str, df.collect()))


def test_analyses_and_dashboard_over_the_registered_tables(spark, saved):
    pipeline, path = saved
    names = warehouse.register(spark, path, "retentio_test")
    assert len(names) == len(WAREHOUSE_TABLES)
    star = warehouse.open_star(spark, path, "retentio_test")
    for name, analysis in analytics.ANALYSES.items():
        assert _set(analysis(star)) == _set(analysis(pipeline.star)), name
    assert _set(dashboard.db_segment_table(star.cube)) == _set(dashboard.db_segment_table(pipeline.star))
    listed = warehouse.describe_catalog(spark, "retentio_test")
    assert listed.where("table_name = 'dim_contract'").orderBy("position").first().data_type == "bigint"
    assert listed.count() == sum(len(c) for c in warehouse.DECLARED.values())
    spark.sql("DROP DATABASE retentio_test CASCADE")
    assert open_warehouse(spark, path)["raw"].count() == 60  # external: the files stay


def test_a_changed_column_is_reported(spark, saved):
    _, path = saved
    assert {r.status for r in warehouse.reconcile(spark, path).collect()} == {"ok"}
    tables = open_warehouse(spark, path)
    other = path + "-changed"
    tables["dim_contract"] = tables["dim_contract"].drop("payment_category").withColumn(
        "contract_key", F.col("contract_key").cast("int")).withColumn("extra", F.lit(1))
    warehouse.save_version(spark, other, tables)
    odd = {(r.table_name, r.column_name): r.status for r in warehouse.reconcile(spark, other).where("status <> 'ok'").collect()}
    assert odd == {("dim_contract", "payment_category"): "missing", ("dim_contract", "contract_key"): "changed", ("dim_contract", "extra"): "unexpected"}
    report = {r.table_name: r for r in warehouse.reconcile_report(spark, other).collect()}
    assert report["dim_contract"].n_differences == 3 and report["raw"].n_rows == 60 and report["raw"].n_differences == 0


def test_a_load_that_fails_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "w")
    with pytest.raises(FileNotFoundError):
        open_warehouse(spark, path)
    Pipeline(spark, raw=raw_rows(spark, _rows(3))).write_warehouse(path)
    good = {"raw": open_warehouse(spark, path)["raw"]}
    broken = good["raw"].select(F.raise_error(F.lit("halfway")).cast("string").alias("x"))
    with pytest.raises(Exception, match="halfway"):
        warehouse.save_version(spark, path, {**good, "staging": broken})
    assert open_warehouse(spark, path)["raw"].count() == 3
    Pipeline(spark, raw=raw_rows(spark, _rows(5))).write_warehouse(path)
    assert open_warehouse(spark, path)["raw"].count() == 5
    assert warehouse.versions(spark, path) == [(1, True), (3, True)]  # the failed load is gone, the one before stays


def test_planted_violations_are_found_on_a_stored_warehouse(spark, saved, tmp_path):
    _, path = saved
    clean = constraints.violations(constraints.declared(), open_warehouse(spark, path))
    assert {r.constraint_name for r in clean.where("violations > 0").collect()} == set()
    t = open_warehouse(spark, path)
    first = t["fact_subscription"].orderBy("subscription_key").limit(2)
    t["fact_subscription"] = (t["fact_subscription"].unionByName(first.withColumn("contract_key", F.lit(999).cast("bigint")))
                              .unionByName(first.limit(1).withColumn("date_key", F.lit(None).cast("int"))))
    t["dim_service_plan"] = t["dim_service_plan"].unionByName(t["dim_service_plan"].limit(1).withColumn("service_key", F.lit(77).cast("bigint")))
    t["dim_customer"] = t["dim_customer"].where("customer_id <> 'C007'")
    t["staging"] = t["staging"].withColumn("churn", F.when(F.col("customer_id") == "C001", "Maybe").otherwise(F.col("churn"))).withColumn(
        "contract_type", F.when(F.col("customer_id") < "C003", " One year ").otherwise(F.col("contract_type")))
    warehouse.save_version(spark, str(tmp_path / "planted"), t)
    found = {(r.table_name, r.constraint_name): r.violations for r in constraints.violations(
        constraints.declared(), open_warehouse(spark, str(tmp_path / "planted"))).where("violations > 0").collect()}
    assert found == {
        ("fact_subscription", "unique: subscription_key"): 3, ("fact_subscription", "unique: customer_id"): 3,
        ("fact_subscription", "reference: contract_key -> dim_contract"): 2, ("fact_subscription", "not null: date_key"): 1,
        ("fact_subscription", "reference: customer_key -> dim_customer"): 1, ("dim_service_plan", "unique: " + ", ".join(
            warehouse.R.SERVICE_COLUMNS)): 1,
        ("staging", "reference: customer_id -> dim_customer"): 1, ("staging", "domain: churn"): 1,
        ("staging", "domain: contract_type"): 3, ("staging", "trimmed: contract_type"): 3}


def test_unknown_tables_and_kinds_are_refused(spark, saved):
    with pytest.raises(ValueError, match="no such tables"):
        constraints.violations([constraints.Constraint("nowhere", "unique", ("x",))], {"raw": saved[0].raw})
    with pytest.raises(ValueError, match="unknown kind"):
        constraints.violations([constraints.Constraint("raw", "odd", ("churn",))], {"raw": saved[0].raw})


def test_null_keys_and_hot_keys(spark):
    child = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 99).when(F.col("id") > 5, F.col("id") % 5).alias("k"))
    parent = spark.range(8).select(F.col("id").alias("k"))
    rules = [constraints.Constraint("child", "reference", ("k",), parent=("parent", ("k",))), constraints.Constraint("child", "unique", ("k",)),
             constraints.Constraint("parent", "unique", ("k",))]
    got = {(r.table_name, r.kind): r.violations for r in constraints.violations(rules, {"child": child, "parent": parent}).collect()}
    n, distinct = child.where("k IS NOT NULL").count(), child.where("k IS NOT NULL").distinct().count()
    assert got == {("child", "reference"): 1, ("child", "unique"): n - distinct, ("parent", "unique"): 0}
