"""The saved warehouse: versions, catalog, reconciliation, and a star over its tables.

*Versions.*  A load is written to a folder of its own and becomes the current
version when its marker file appears, which is one atomic step on any store.
A load that fails halfway is never seen; the version before the current one is
kept for its readers, older ones go.

*Catalog.*  ``register`` makes the tables of a version external tables of the
session catalog, so SQL finds and describes them by name.

*Reconciliation.*  What the files hold is compared with what is declared,
column by column, with row counts.

*Star.*  ``open_star`` gives the 26 analyses and the dashboard what they read:
the stored fact joined with the stored dimensions, small ones broadcast behind
a count, the customers by a shuffle join that AQE splits where it is skewed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.joins import broadcast_or_merge
from ..sources.subscribers import RAW_COLUMNS
from .cube import FILTER_DIMENSIONS, MEASURES, Cube
from .pipeline import WAREHOUSE_TABLES
from .staging import MONEY, STAGING_RENAMES

_MARKER = "_COMPLETE"

# --- fixed values: columns and types that the tables declare
_STAGING = {dst: "int" if dst == "tenure_months" else MONEY if dst in ("monthly_charges", "total_charges") else "string"
            for _, dst in STAGING_RENAMES} | {"loaded_at": "timestamp"}
_TEXTS = {c: "string" for c in (*R.CONTRACT_COLUMNS, *R.SERVICE_COLUMNS)}
DECLARED: dict[str, dict[str, str]] = {
    "raw": {c: "string" for c in RAW_COLUMNS},
    "quarantine": {c: "string" for c in (*RAW_COLUMNS, "reason")},
    "staging": _STAGING,
    "dim_customer": {"customer_key": "bigint"} | {c: "string" for c in (
        "customer_id", "gender", "senior_citizen", "partner", "dependents", "household_type", "senior_segment")},
    "dim_contract": {"contract_key": "bigint"} | {c: "string" for c in (*R.CONTRACT_COLUMNS, "payment_category", "contract_length")},
    "dim_service_plan": {"service_key": "bigint"} | {c: "string" for c in R.SERVICE_COLUMNS} | {"total_addons": "int", "internet_tier": "string"},
    "dim_tenure": {"date_key": "int", "tenure_months": "int", "tenure_bucket": "string", "tenure_year": "int",
                   "is_new_customer": "boolean", "is_long_term": "boolean"},
    "fact_subscription": {
        "subscription_key": "bigint", "customer_key": "bigint", "contract_key": "bigint", "service_key": "bigint", "date_key": "int",
        "customer_id": "string", "tenure_months": "int", "monthly_charges": MONEY, "total_charges": MONEY,
        "estimated_clv": "decimal(12,2)", "mrr_at_risk": MONEY, "churn": "string", "is_churned": "boolean", "loaded_at": "timestamp"},
    "cube_cells": {c: "string" for c in (*FILTER_DIMENSIONS, "addon_group")} | {m: "bigint" for m in MEASURES},
    "cube_charges": {c: "string" for c in FILTER_DIMENSIONS} | {"charge_step": "bigint", "customers": "bigint", "mrr": "bigint"},
}
# ---------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of the versions at ``path`` in order, and whether each is complete."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path(path))]
    found = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
    return [(n, bool(fs.exists(hadoop_path(f"{path}/v{n}/{_MARKER}")))) for n in found]


def save_version(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write the tables as the next version; the folder it is in."""
    path = path.rstrip("/")
    known = versions(spark, path)
    folder = f"{path}/v{(known[-1][0] if known else 0) + 1}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    fs, hadoop_path = _fs(spark, path)
    fs.create(hadoop_path(f"{folder}/{_MARKER}"), False).close()
    complete = [n for n, done in known if done]
    for n, _ in known:  # all but the one before
        if not complete or n != complete[-1]:
            fs.delete(hadoop_path(f"{path}/v{n}"), True)
    return folder


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version."""
    complete = [n for n, done in versions(spark, path.rstrip("/")) if done]
    if not complete:
        raise FileNotFoundError(f"no complete warehouse at {path}")
    return f"{path.rstrip('/')}/v{complete[-1]}"


def register(spark: SparkSession, path: str, database: str = "retentio") -> list[str]:
    """External tables of the current version in the session catalog; their names."""
    folder = current_version(spark, path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for name in WAREHOUSE_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")  # an external table: the files stay
        spark.catalog.createTable(f"{database}.{name}", path=f"{folder}/{name}", source="parquet")
        names.append(f"{database}.{name}")
    return names


def describe_catalog(spark: SparkSession, database: str = "retentio") -> DataFrame:
    """table_name, column_name, position and data_type of the registered tables."""
    rows = [(t.name, c.name, i, c.dataType) for t in spark.catalog.listTables(database) if not t.isTemporary
            for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")


def reconcile(spark: SparkSession, path: str) -> DataFrame:
    """table_name, column_name, declared_type, found_type and status (ok, changed, missing, unexpected) of every column
    that is declared or found in the files of the current version."""
    folder, rows = current_version(spark, path), []
    fs, hadoop_path = _fs(spark, folder)
    for table, declared in DECLARED.items():
        there = fs.exists(hadoop_path(f"{folder}/{table}"))
        found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{folder}/{table}").schema.fields} if there else {}
        for column in dict.fromkeys([*declared, *found]):
            want, has = declared.get(column), found.get(column)
            status = "ok" if want == has else "missing" if has is None else "unexpected" if want is None else "changed"
            rows.append((table, column, want, has, status))
    return spark.createDataFrame(rows, "table_name string, column_name string, declared_type string, found_type string, status string")


def reconcile_report(spark: SparkSession, path: str) -> DataFrame:
    """table_name, n_columns (found), n_differences and n_rows of every declared table."""
    folder = current_version(spark, path)
    counts = None
    for table in DECLARED:
        one = spark.read.parquet(f"{folder}/{table}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table).alias("t"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    columns = reconcile(spark, path).groupBy("table_name").agg(
        F.count("found_type").alias("n_columns"), F.count_if(F.col("status") != "ok").alias("n_differences"))
    return columns.join(counts, columns["table_name"] == counts["t"]).select("table_name", "n_columns", "n_differences", "n_rows").orderBy("table_name")


class StoredStar:
    """What the analyses and the dashboard read of a star, from the tables of a saved warehouse."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables = tables
        self.fact = tables["fact_subscription"]
        self.dim_customer, self.dim_contract = tables["dim_customer"], tables["dim_contract"]
        self.dim_service_plan, self.dim_tenure = tables["dim_service_plan"], tables["dim_tenure"]
        self.staging = tables["staging"]

    @cached_property
    def fact_enriched(self) -> DataFrame:
        out = self.fact
        for dim, key, drop in ((self.dim_customer, "customer_key", ["customer_id"]), (self.dim_contract, "contract_key", []),
                               (self.dim_service_plan, "service_key", []), (self.dim_tenure, "date_key", ["tenure_months"])):
            out = out.join(broadcast_or_merge(dim.drop(*drop)), key)
        return out

    @cached_property
    def cube(self) -> Cube:
        return Cube(cells=self._tables["cube_cells"], charges=self._tables["cube_charges"])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self._tables[name] for name in ("dim_customer", "dim_contract", "dim_service_plan", "dim_tenure", "fact_subscription")}


def open_star(spark: SparkSession, path: str, database: str | None = None) -> StoredStar:
    """The star of the warehouse at ``path``, or of the tables registered under ``database``."""
    if database:
        return StoredStar({name: spark.table(f"{database}.{name}") for name in WAREHOUSE_TABLES})
    from .pipeline import open_warehouse

    return StoredStar(open_warehouse(spark, path))
