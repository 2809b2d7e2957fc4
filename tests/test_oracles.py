"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

from __future__ import annotations

import os

import pytest

from retentio.oracle import oracle_sql
from retentio.oracle.compare import compare
from retentio.registry import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(queries())


SPARK_TO_DUCKDB = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    failed = {k: r for k, r in res.items() if "error" in r or (k in oracle_sql() and not r.get("values_ok"))}
    assert not failed, failed
    assert len(res) == 97
    # same column types on both sides, not only equal values
    types = [(k, c, s, d) for k, r in res.items() for c, s, d in r["type_pairs"] if SPARK_TO_DUCKDB.get(s) != d]
    assert not types, types
