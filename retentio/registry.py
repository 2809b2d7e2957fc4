"""Registered queries: key → callable(spark, sf_dir) → DataFrame.

Every query derives the subscriber table from the parquet tables under
``sf_dir`` and runs over all of it.  A pipeline (raw → staging → star) is
shared between calls on the same session and location, so the customer
numbering and dimension checkpoints are built once per location.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.pipeline import Pipeline

_PIPELINES: dict[tuple[int, str], tuple[list, Pipeline]] = {}
_LOCK = threading.RLock()
_TABLES = ("orders", "customer", "lineitem")


def _files(spark: SparkSession, sf_dir: str) -> list:
    """Path, length and time of every input file, as the file system has them now."""
    jvm = spark.sparkContext._jvm
    found = []
    for name in _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)  # those of partition folders, too
        while files.hasNext():
            f = files.next()
            found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(found)


def pipeline(spark: SparkSession, sf_dir: str) -> Pipeline:
    """The shared pipeline for (session, location, input files); callers on
    several threads get the same one, and overwritten inputs a new one."""
    key = (id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        files = _files(spark, key[1])
        known, p = _PIPELINES.get(key, (None, None))
        if p is None or p.spark is not spark or known != files:
            p = Pipeline(spark, sf_dir)
            _PIPELINES[key] = (files, p)
        return p


def _doubles(df: DataFrame) -> DataFrame:
    """Decimal columns leave as DOUBLE (one numeric type for every consumer)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DecimalType

    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
          for f in df.schema.fields]
    )


def _ingest_roundtrip(p: Pipeline) -> DataFrame:
    """Write the derived subscriber records as a CSV landing file in the shared
    checkpoint folder, then run the raw loader on it."""
    from .session import scratch_path
    from .sources.csv_ingest import ing_raw_load, write_raw_csv

    base = scratch_path(p.spark, "retentio-ingest")
    write_raw_csv(p.raw, f"{base}/landing")
    return ing_raw_load(p.spark, f"{base}/landing", f"{base}/raw")


def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import analytics, constraints, dashboard, eda, inference, profile, quality, stats, warehouse

    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def add(name: str, fn: Callable[[Pipeline], DataFrame]) -> None:
        q[name] = lambda spark, sf_dir, _fn=fn: _fn(pipeline(spark, sf_dir))

    # ingest / staging
    add("ing_raw_load", _ingest_roundtrip)
    add("stg_clean", lambda p: _doubles(p.staging.drop("loaded_at")))
    add("stg_quarantine", lambda p: p.quarantine)
    # star
    add("dim_customer", lambda p: p.star.dim_customer)
    add("dim_contract", lambda p: p.star.dim_contract)
    add("dim_service_plan", lambda p: p.star.dim_service_plan)
    add("fact_subscription", lambda p: _doubles(p.star.fact.drop("loaded_at")))
    # profiling (raw)
    add("prof_shape", lambda p: profile.prof_shape(p.raw))
    add("prof_sample", lambda p: profile.prof_sample(p.raw))
    add("prof_missing", lambda p: profile.prof_missing(p.raw))
    add("prof_blank", lambda p: profile.prof_blank(p.raw))
    add("prof_duplicates", lambda p: profile.prof_duplicates(p.raw))
    add("prof_categories", lambda p: profile.prof_categories(p.raw))
    add("prof_numeric", lambda p: profile.prof_numeric(p.raw, types=p.raw_types))
    add("prof_types", lambda p: inference.prof_types(p.raw_types))
    add("prof_coerce", lambda p: profile.prof_coerce(p.raw))
    add("prof_target", lambda p: profile.prof_target(p.raw))
    # quality
    add("dq_row_counts", lambda p: quality.dq_row_counts(p.raw, p.staging, p.star))
    add("dq_nulls", lambda p: quality.dq_nulls(p.raw, p.staging))
    add("dq_recode", lambda p: quality.dq_recode(p.raw, p.staging))
    add("dq_blank_to_null", lambda p: quality.dq_blank_to_null(p.raw, p.staging))
    add("dq_null_detail", lambda p: quality.dq_null_detail(p.staging))
    add("dq_range", lambda p: quality.dq_range(p.staging))
    add("dq_domain", lambda p: quality.dq_domain(p.staging))
    add("dq_whitespace", lambda p: quality.dq_whitespace(p.staging))
    add("dq_contract_mix", lambda p: quality.dq_contract_mix(p.staging))
    add("dq_payment_mix", lambda p: quality.dq_payment_mix(p.staging))
    add("dq_flag_consistency", lambda p: quality.dq_flag_consistency(p.star))
    add("dq_mrr_total", lambda p: quality.dq_mrr_total(p.star))
    add("dq_contract_revenue", lambda p: quality.dq_contract_revenue(p.star))
    add("dq_orphans", lambda p: quality.dq_orphans(p.star.fact, quality.star_dims(p.star)))
    add("dq_dim_listing", lambda p: quality.dq_dim_listing(p.star))
    add("dq_dim_profile", lambda p: quality.dq_dim_profile(p.star))
    add("dq_constraints", lambda p: constraints.violations(constraints.declared(), constraints.candidate_tables(p)))
    # the warehouse as saved
    add("wh_reconcile", lambda p: warehouse.reconcile_report(p.spark, p.saved))
    add("wh_risk_profile", lambda p: analytics.q6a_risk_profile(warehouse.open_star(p.spark, p.saved)))
    # analyses
    for name, fn in analytics.ANALYSES.items():
        add(name, lambda p, _fn=fn: _fn(p.star))
    # EDA datasets
    for name in ["eda_histogram", "eda_churn_by_category", "eda_box_stats", "eda_iqr_outliers", "eda_correlation",
                 "eda_churn_drivers", "eda_scatter_bins", "eda_addon_stickiness", "eda_summary"]:
        add(name, lambda p, _fn=getattr(eda, name): _fn(p.staging))
    # statistical tests
    add("st_crosstab", lambda p: stats.st_crosstab(p.staging, "contract_type", "churn"))
    add("st_chi_square", lambda p: stats.st_chi_square(p.staging))
    add("st_mann_whitney", lambda p: stats.st_mann_whitney(p.staging))
    # dashboard datasets
    for name, fn in dashboard.DASHBOARD.items():
        add(name, lambda p, _fn=fn: _fn(p.star))
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _registry()
