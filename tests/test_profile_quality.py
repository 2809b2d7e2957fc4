"""Profiling, quality checks and the CSV loader on hand-made raw rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retentio.plans import profile as P
from retentio.plans import quality as Q
from retentio.plans.staging import stg_clean
from retentio.session import ensure_checkpoint_dir
from retentio.sources.csv_ingest import ing_raw_load, write_raw_csv

from .conftest import raw_rows


def test_missing_blank_duplicates(spark):
    raw = raw_rows(spark, [
        {"customerid": "M1", "totalcharges": " "},
        {"customerid": "M2", "totalcharges": "\t"},
        {"customerid": "M3", "gender": None},
        {"customerid": "M3", "gender": None},
        {"customerid": "M4", "partner": "Yes "},
    ])
    missing = {r.column_name: (r.missing_count, r.missing_pct) for r in P.prof_missing(raw).collect()}
    assert missing == {"gender": (2, 40.0)}
    blank = {r.column_name: r.blank_count for r in P.prof_blank(raw).collect()}
    assert blank == {"totalcharges": 2, "*": 2}  # str.strip() removes the tab too
    d = P.prof_duplicates(raw).first()
    assert (d.duplicate_rows, d.duplicate_keys) == (1, 1)  # NULLs compare equal, like pandas


def test_numeric_inference_and_describe(spark):
    raw = raw_rows(spark, [{"customerid": f"D{i}", "tenure": str(i), "monthlycharges": f"{10 + i}.25",
                            "totalcharges": " " if i == 0 else "5"} for i in range(5)])
    assert list(P.numeric_columns(raw)) == ["seniorcitizen", "tenure", "monthlycharges"]
    r = {x.column_name: x for x in P.prof_numeric(raw).collect()}
    t = r["tenure"]
    assert (t["count"], t["mean"], t["min"], t["p25"], t["p50"], t["p75"], t["max"]) == (5, 2.0, 0.0, 1.0, 2.0, 3.0, 4.0)
    assert t["std"] == round((2.5) ** 0.5, 2)
    coerce = P.prof_coerce(raw).collect()
    assert [c.customerid for c in coerce] == ["D0"]


def test_domain_and_whitespace_checks(spark):
    raw = raw_rows(spark, [
        {"customerid": "Q1", "partner": "Maybe"},
        {"customerid": "Q2", "seniorcitizen": "7"},  # → NULL senior: not counted by NOT IN
        {"customerid": "Q3", "gender": "\tFemale"},  # TRIM keeps the tab
    ])
    stg = stg_clean(raw)
    dom = {r.subject: r.observed for r in Q.dq_domain(stg).collect()}
    assert dom["partner"] == 1 and dom["senior_citizen"] == 0
    ws = {r.subject: r.observed for r in Q.dq_whitespace(stg).collect()}
    assert ws["gender"] == 0  # TRIM removes spaces only, so trim(gender) equals gender
    nulls = {r.subject: r.observed for r in Q.dq_nulls(raw, stg).collect()}
    assert nulls["staging.senior_citizen"] == 1
    rec = {(r.layer, r.value): r.allowed for r in Q.dq_recode(raw, stg).collect()}
    assert rec[("staging.senior_citizen", None)] is None  # NULL is neither allowed nor refused


def test_csv_round_trip_keeps_blanks_and_maps_na_tokens(spark):
    raw = raw_rows(spark, [
        {"customerid": "L1", "totalcharges": " "},
        {"customerid": "L2", "multiplelines": "NA"},
        {"customerid": "L3", "paymentmethod": "Bank transfer (automatic)"},
    ])
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-ingest-{uuid.uuid4().hex}"
    write_raw_csv(raw.toDF(*[c.upper() for c in raw.columns]), f"{base}/landing")
    loaded = ing_raw_load(spark, f"{base}/landing", f"{base}/raw")
    assert loaded.columns == raw.columns  # names lower-cased
    got = {r.customerid: r for r in loaded.collect()}
    assert got["L1"].totalcharges == " "
    assert got["L2"].multiplelines is None
    assert got["L3"].paymentmethod == "Bank transfer (automatic)"
    assert all(f.dataType.simpleString() == "string" for f in loaded.schema.fields)


def test_blank_to_null_reconciliation(spark):
    raw = raw_rows(spark, [{"customerid": "Z1", "tenure": "0", "totalcharges": " "},
                           {"customerid": "Z2", "tenure": "3", "totalcharges": "30.00"}])
    stg = stg_clean(raw)
    r = Q.dq_blank_to_null(raw, stg).first()
    assert (r.observed, r.expected, r.ok) == (1.0, 1.0, True)
    detail = Q.dq_null_detail(stg).collect()
    assert [(d.customer_id, d.tenure_is_zero) for d in detail] == [("Z1", True)]
    assert stg.where(F.col("total_charges").isNull()).count() == 1


def test_profile_rounds_at_the_end(spark):
    raw = spark.createDataFrame([("0.004",), ("0.004",), ("0.0121",), (None,)], "x string")
    assert P.numeric_columns(raw) == {"x": 4}
    r = P.prof_numeric(raw).first()
    assert (r["count"], r["mean"], r["max"]) == (3, 0.01, 0.01)  # 0.0067 and 0.0121, not the mean of rounded values
    fine = P.describe(raw, ["x"], scale=4, decimals=4).first()
    assert (fine["mean"], fine["min"], fine["p50"], fine["max"]) == (0.0067, 0.004, 0.004, 0.0121)


def test_duplicates_count_rows_and_keys(spark):
    raw = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)], "customerid string, v int")
    r = P.prof_duplicates(raw).first()
    assert (r.duplicate_rows, r.duplicate_keys) == (2, 3)
    assert P.prof_duplicates(raw.limit(0)).first().asDict() == {"duplicate_rows": 0, "duplicate_keys": 0}


def test_csv_quotes_backslashes_and_line_breaks(spark, tmp_path):
    from retentio.sources.csv_ingest import ing_raw_load, read_csv_inferred, write_raw_csv

    (tmp_path / "in.csv").write_text('Customer ID,note\n1,"say ""hi"" there"\n2,"ends in \\"\n3,"two\nlines"\n4," "\n5,NA\n')
    got = {r.customer_id: r.note for r in ing_raw_load(spark, str(tmp_path / "in.csv"), str(tmp_path / "raw")).collect()}
    assert got == {"1": 'say "hi" there', "2": "ends in \\", "3": "two\nlines", "4": " ", "5": None}
    write_raw_csv(spark.read.parquet(str(tmp_path / "raw")), str(tmp_path / "out"))
    again = {r.customer_id: r.note for r in ing_raw_load(spark, str(tmp_path / "out"), str(tmp_path / "raw2")).collect()}
    assert again == got
    assert dict(read_csv_inferred(spark, str(tmp_path / "in.csv")).dtypes) == {"Customer ID": "int", "note": "string"}


def _types(spark, columns):
    import itertools

    from retentio.plans.inference import column_types

    rows = list(itertools.zip_longest(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return {r.column_name: r for r in column_types(df).collect()}


def test_types_are_the_join_of_all_values(spark):
    t = _types(spark, {
        "none": [None, None], "truth": ["True", None, "false"], "int": ["1", "-22", "+333", "000000000000007"],
        "long": ["1234567890", " 5 "], "exact": ["1.5", "22", "-.25", "7."], "wide": ["1" * 30, "0.12345678"],
        "double": ["1e25", "2"], "inf": ["inf", "1"], "huge": ["9" * 39], "mixed": ["True", "1"], "text": ["1", "x"], "blank": ["1", " "],
        "signs": ["+-1"], "inner": ["1-2"], "dots": ["1.2.3"], "point": ["."], "empty": [""], "exp": ["1e"]})
    assert {c: r.inferred_type for c, r in t.items()} == {
        "none": "missing", "truth": "boolean", "int": "int", "long": "bigint", "exact": "decimal(4,2)", "wide": "decimal(38,8)",
        "double": "double", "inf": "double", "huge": "double", "mixed": "text", "text": "text", "blank": "text", "signs": "text",
        "inner": "text", "dots": "text", "point": "text", "empty": "text", "exp": "text"}
    assert (t["int"].width, t["int"].missing_count, t["none"].width, t["truth"].missing_count) == (15, t["int"].n_values - 4, 0, t["truth"].n_values - 2)


def test_kinds_of_two_loads_merge(spark):
    from retentio.plans.inference import column_kinds, merge_kinds, type_name

    a = spark.createDataFrame([("1", "x"), ("2.25", None)], "a string, b string")
    b = spark.createDataFrame([("1e3", None)], "a string, b string")
    parts = column_kinds(a).unionByName(column_kinds(b))
    merged = {r.column_name: r for r in merge_kinds(parts).select("*", type_name().alias("t")).collect()}
    whole = {r.column_name: r for r in column_kinds(a.unionByName(b)).select("*", type_name().alias("t")).collect()}
    assert merged == whole and merged["a"].t == "double" and merged["b"].missing_count == 2


def test_numbers_of_any_size_are_described(spark):
    import statistics

    small, large = ["1.123456789012", "2", "3.5"], ["1e25", "-3e25", "5"]
    raw = spark.createDataFrame(list(zip(small, large, ["1e300", "1", "2"])), "small string, large string, sparse string")
    out = {r.column_name: r for r in P.prof_numeric(raw).collect()}
    assert out["small"].mean == round(statistics.mean(map(float, small)), 2) and out["small"]["count"] == 3
    assert out["large"].max == 1e25 and out["large"].min == -3e25 and out["large"].p50 == 5.0
    assert abs(out["large"]["std"] / statistics.stdev(map(float, large)) - 1) < 1e-12
    assert out["sparse"].p75 == 5e299
    # a large common part costs no digits
    near = spark.createDataFrame([(str(10**14 + i) + ".25",) for i in range(5)], "x string")
    assert P.prof_numeric(near).first().mean == 10**14 + 2.25


def test_duplicates_by_hash_tell_collisions_apart(spark):
    rows = [("a", "1", None), ("a", "1", None), ("a", None, "1"), (None, "x", "y"), (None, "x", "y"), (None, "x", "z"), ("b", "1", "1")]
    raw = spark.createDataFrame(rows, "customerid string, x string, y string")
    want = (2, 4)  # two rows again; a twice and null twice beyond the first
    assert tuple(P.prof_duplicates(raw).first()) == want

    def all_alike(columns):
        return [F.lit(1).alias("_h1"), F.lit(2).alias("_h2")]

    assert tuple(P.prof_duplicates(raw, hash_of=all_alike).first()) == want
    assert tuple(P.prof_duplicates(raw.limit(0)).first()) == (0, 0)
    assert tuple(P.prof_duplicates(raw.dropDuplicates(["customerid"])).first()) == (0, 0)


def test_kinds_are_told_without_a_translate_a_character(spark):
    from retentio.plans.inference import column_kinds, column_types

    plan = column_kinds(spark.createDataFrame([("1", "x")], "a string, b string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and plan.count("trim(") <= 3  # a value is trimmed once, its kind is found once
    values = {"1e5\u0085": "text", "+Inf": "double", "Infinity": "double", "-infinity": "double", "infix": "text", "-.": "text", "/1": "text",
              ",5": "text", "+.5": "decimal(1,1)", "-007.50": "decimal(3,2)", "1.e3": "double", "١": "text", "12 ": "text", "0": "int"}
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    got = {r.column_name: r.inferred_type for r in column_types(df).collect()}
    assert got == {f"c{i}": t for i, t in enumerate(values.values())}


def test_short_numbers_are_grouped_as_bigint(spark, monkeypatch):
    """Units of at most 12 digits are moved and sorted as bigint, and described as the wide integers are."""
    raw = spark.createDataFrame(
        [("-9999999999.99", "0.123456789012", "007"), ("9999999999.99", "-0.999999999999", "+5"), (" 1.5", "0", "-3"), (None, ".5", None)],
        "cents string, fine string, whole string")
    kinds, real = [], P.order_statistics
    monkeypatch.setattr(P, "order_statistics", lambda df, value, *a, **k: kinds.append(dict(df.dtypes)[value]) or real(df, value, *a, **k))
    narrow = P.prof_numeric(raw).collect()
    scales = P.numeric_columns(raw)
    assert scales == {"cents": 2, "fine": 12, "whole": 0}
    assert kinds == ["bigint"] and narrow == P.describe(raw, list(scales), decimals=scales).collect()
    assert {r.column_name: (r.min, r.max) for r in narrow}["cents"] == (-9999999999.99, 9999999999.99)
