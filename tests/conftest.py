from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retentio.session import ensure_checkpoint_dir  # noqa: E402
from retentio.sources.subscribers import RAW_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


BASE_ROW = {
    "customerid": "C0001", "gender": "Female", "seniorcitizen": "0", "partner": "Yes", "dependents": "No",
    "tenure": "10", "phoneservice": "Yes", "multiplelines": "No", "internetservice": "DSL",
    "onlinesecurity": "Yes", "onlinebackup": "No", "deviceprotection": "No", "techsupport": "No",
    "streamingtv": "No", "streamingmovies": "No", "contract": "Month-to-month", "paperlessbilling": "Yes",
    "paymentmethod": "Electronic check", "monthlycharges": "50.00", "totalcharges": "500.00", "churn": "No",
}


def raw_rows(spark, rows: list[dict]):
    """Raw (21 string columns) DataFrame from partial dicts over BASE_ROW."""
    data = [tuple({**BASE_ROW, **r}[c] for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW_COLUMNS))
