"""Run registered Spark queries and their DuckDB oracles side by side.

    python -m retentio.oracle.compare [sf_dir] [key ...]

Prints one line per key: row counts, schema match, value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, sf_dir: str, keys: list[str] | None = None, verbose: bool = True) -> dict[str, dict]:
    from ..registry import queries
    from . import oracle_sql

    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for key in keys or list(qs):
        rec: dict = {}
        t0 = time.time()
        try:
            sdf = qs[key](spark, sf_dir)
            s_cols = sdf.columns
            s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
            s_rows = [tuple(r) for r in sdf.collect()]
            rec["spark_rows"] = len(s_rows)
            rec["spark_sec"] = round(time.time() - t0, 2)
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"spark: {type(e).__name__}: {str(e)[:400]}"
            results[key] = rec
            if verbose:
                print("FAIL", key, rec, flush=True)
            continue
        if key in os_:
            try:
                res = con.execute(os_[key])
                d_cols = [d[0] for d in res.description]
                d_types = [str(d[1]) for d in res.description]
                d_rows = res.fetchall()
                rec["oracle_rows"] = len(d_rows)
                rec["names_ok"] = sorted(s_cols) == sorted(d_cols)
                rec["types"] = list(zip(s_cols, s_types, d_types)) if not rec["names_ok"] else None
                if rec["names_ok"]:
                    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
                    rec["values_ok"] = a == b
                    if not rec["values_ok"]:
                        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                        rec["diff"] = diff
                        rec["cols"] = sorted(s_cols)
                    theirs = dict(zip(d_cols, d_types))
                    rec["type_pairs"] = sorted((c, t, theirs[c]) for c, t in zip(s_cols, s_types))
                else:
                    rec["spark_cols"], rec["oracle_cols"] = s_cols, d_cols
            except Exception as e:  # noqa: BLE001
                rec["error"] = f"oracle: {type(e).__name__}: {str(e)[:400]}"
        ok = rec.get("values_ok")
        brief = {k: v for k, v in rec.items() if k not in ("type_pairs", "types")}
        if verbose:
            print(("OK  " if ok else ("ROWS" if key not in os_ else "FAIL")), key, brief, flush=True)
        results[key] = rec
    return results


if __name__ == "__main__":
    from ..session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session()
    compare(spark, sf, keys)
