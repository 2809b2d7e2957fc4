"""retentio — subscription churn and revenue analytics as Spark jobs.

Layers (each a lazily evaluated DataFrame plan):

* ``sources``   — raw subscriber records (CSV ingest, or derived from the
  order/customer/lineitem parquet tables).
* ``plans.staging`` — typed cleaning and quarantine.
* ``plans.star``    — dimensions + subscription fact.
* ``plans.*``       — profiling, quality checks, analyses, EDA datasets,
  statistical tests and dashboard datasets.
* ``operators``     — the few pieces Spark lacks as one call: global ordering
  without a single-partition exchange, exact distributed percentiles.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
