"""Chi-square and Mann–Whitney against hand-worked / brute-force values."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.plans.stats import chi2_sf, chi_square, chi_squares_of_cells, contingency, crosstab_map, mann_whitney, mann_whitneys, normal_two_sided_p


def _contingency(spark, table: dict[tuple[str, str], int]):
    rows = [(r, c) for (r, c), n in table.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def _chi2_by_hand(table, yates):
    rs = sorted({r for r, _ in table})
    cs = sorted({c for _, c in table})
    n = sum(table.values())
    rt = {r: sum(table.get((r, c), 0) for c in cs) for r in rs}
    ct = {c: sum(table.get((r, c), 0) for r in rs) for c in cs}
    x = 0.0
    for r in rs:
        for c in cs:
            e = rt[r] * ct[c] / n
            d = abs(table.get((r, c), 0) - e)
            if yates:
                d = max(0.0, d - 0.5)
            x += d * d / e
    return x


def test_chi_square_of_huge_counts_and_either_ansi_setting(spark):
    counts = {("x", "yes"): 3 * 10**12, ("x", "no"): 10**12, ("y", "yes"): 10**12, ("y", "no"): 2 * 10**12,
              ("z", "yes"): 7, ("z", "no"): 10**12}
    cells = spark.createDataFrame([("t", r, c, n) for (r, c), n in counts.items()], "test string, r string, c string, o bigint")
    r = chi_squares_of_cells(cells).first()
    assert r.chi2 == pytest.approx(_chi2_by_hand(counts, False), rel=1e-9) and r.dof == 2
    small = {("x", "yes"): 900, ("x", "no"): 60, ("y", "yes"): 100, ("y", "no"): 2000, ("z", "no"): 40}
    big = spark.range(2000).crossJoin(_contingency(spark, small))  # 6.2 million rows
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            r = chi_square(big, "a", "b").first()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        hand = _chi2_by_hand({k: 2000 * n for k, n in small.items()}, False)
        assert r.chi2 == pytest.approx(hand, rel=1e-9) and r.dof == 2


def test_tests_scan_once_and_run_no_python(spark):
    from retentio.plans import stats
    from retentio.registry import pipeline

    staging = pipeline(spark, "/root/testdata/sf0.001").staging
    for test in (stats.st_chi_square, stats.st_mann_whitney):
        plan = test(staging)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan and "Arrow" not in plan


def test_chi_square_2x2_uses_yates(spark):
    t = {("x", "yes"): 12, ("x", "no"): 5, ("y", "yes"): 3, ("y", "no"): 14}
    r = chi_square(_contingency(spark, t), "a", "b").first()
    assert r.dof == 1
    want = _chi2_by_hand(t, True)
    assert r.chi2 == pytest.approx(want, abs=1e-6)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(want / 2)), abs=1e-8)


def test_chi_square_3x2_no_correction(spark):
    t = {("m", "yes"): 30, ("m", "no"): 10, ("o", "yes"): 12, ("o", "no"): 20, ("t", "yes"): 4, ("t", "no"): 25}
    r = chi_square(_contingency(spark, t), "a", "b").first()
    assert r.dof == 2
    want = _chi2_by_hand(t, False)
    assert r.chi2 == pytest.approx(want, abs=1e-6)
    assert r.p_value == pytest.approx(math.exp(-want / 2), abs=1e-9)
    assert r.significant


def sf(spark, x, dof):
    return spark.range(1).select(chi2_sf(F.lit(float(x)), F.lit(dof)).alias("p")).first().p


def test_chi2_sf_odd_dof(spark):
    # Q(3/2, y) = erfc(sqrt y) + 2 sqrt(y/pi) e^-y
    x = 4.2
    y = x / 2
    assert sf(spark, x, 3) == pytest.approx(math.erfc(math.sqrt(y)) + 2 * math.sqrt(y / math.pi) * math.exp(-y), rel=1e-12)


def test_mann_whitney_brute_force(spark):
    first = [3, 5, 5, 7, 9, 9, 9, 12, 15, 15]
    second = [1, 2, 5, 5, 6, 9, 10, 11, 11]
    rows = [(v, True) for v in first] + [(v, False) for v in second]
    df = spark.createDataFrame(rows, "v long, g boolean")
    r = mann_whitney(df, F.col("v"), F.col("g"), "v").first()
    s = pd.Series(first + second).rank(method="average")
    r1 = s[: len(first)].sum()
    n1, n2 = len(first), len(second)
    u1 = r1 - n1 * (n1 + 1) / 2
    assert r.u_statistic == u1
    counts = pd.Series(first + second).value_counts()
    ties = float(((counts**3) - counts).sum())
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma
    assert r.z == pytest.approx(z, abs=1e-9)
    assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)
    assert r.median_first == 9.0 and r.median_second == 6.0


def _enumerated(first, second):
    """Two-sided p by all ways to pick the first sample's ranks."""
    import itertools

    values = sorted(first + second)
    n, m = len(values), len(first)

    def u(places):
        return sum(places) + m - m * (m + 1) // 2

    seen = u([values.index(v) for v in first])
    low = min(seen, m * (n - m) - seen)
    all_u = [u(c) for c in itertools.combinations(range(n), m)]
    return min(1.0, 2 * sum(x <= low for x in all_u) / len(all_u))


def test_small_samples_without_ties_are_exact(spark):
    import random

    rng = random.Random(4)
    cases = {}
    for k, (m, n) in enumerate([(1, 1), (1, 9), (2, 5), (3, 3), (4, 9), (8, 8), (8, 12), (12, 5), (20, 2)]):
        values = rng.sample(range(1000), m + n)
        cases[f"v{k}"] = (values[:m], values[m:])
    cases["apart"] = (list(range(6)), list(range(10, 19)))
    rows = [(name, v, g) for name, (a, b) in cases.items() for vs, g in ((a, True), (b, False)) for v in vs]
    rows += [("ties", v, v % 2 == 0) for v in (1, 1, 2, 3, 4)] + [("large", v, v % 3 == 0) for v in range(40)]
    df = spark.createDataFrame(rows, "name string, v bigint, g boolean")
    out = {r.variable: r for r in mann_whitneys(df, {
        name: (F.when(F.col("name") == name, F.col("v")), 1) for name in [*cases, "ties", "large"]}, F.col("g")).collect()}
    for name, (a, b) in cases.items():
        assert out[name].p_value == pytest.approx(_enumerated(a, b), abs=1e-9), name
    for name in ("ties", "large"):  # the large-sample method
        assert out[name].p_value == pytest.approx(math.erfc(abs(out[name].z) / math.sqrt(2)), abs=1e-9)


def test_exact_p_of_a_small_and_a_large_sample(spark):
    """Against the counting recurrence f(m, n, u) = f(m - 1, n, u - n) + f(m, n - 1, u), by the parts of a partition."""
    m, n = 4, 900
    rng = __import__("random").Random(8)
    values = rng.sample(range(100_000), m + n)
    df = spark.createDataFrame([(v, i < m) for i, v in enumerate(values)], "v bigint, g boolean")
    r = mann_whitney(df, F.col("v"), F.col("g"), "v").first()
    low = int(min(r.u_statistic, m * n - r.u_statistic))
    counts = [[1] + [0] * low for _ in range(n + 1)]  # counts[k][u] for the current j, parts up to k
    for j in range(1, m + 1):
        new = [[1] + [0] * low]
        for k in range(1, n + 1):
            new.append([new[k - 1][u] + (counts[k][u - k] if u >= k else 0) for u in range(low + 1)])
        counts = new
    assert r.p_value == pytest.approx(min(1.0, 2 * sum(counts[n]) / math.comb(m + n, m)), rel=1e-9)


def test_contingency_finds_its_columns_and_margins(spark):
    rows = [("x", "yes"), ("x", "yes"), ("x", None), ("y", "no"), (None, "no"), ("z", "new")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("count", F.lit(1).cast("bigint"))
    frame = pd.DataFrame(rows, columns=["a", "b"]).fillna("-")
    want = pd.crosstab(frame.a, frame.b)
    got = contingency(df, "a", "b").collect()
    assert len(got) == want.size
    for r in got:
        a, b = r.row_value or "-", r.col_value or "-"
        assert (r["count"], r.row_count, r.col_count, r.all_count) == (want.loc[a, b], want.loc[a].sum(), want[b].sum(), len(rows))
    wide = {r.row_value: r for r in crosstab_map(df, "a", "b").select(
        "row_value", "row_count", F.map_keys("cells").alias("keys"), F.map_values("cells").alias("values")).collect()}
    assert [k.col_value for k in wide["x"]["keys"]] == [None, "new", "no", "yes"]
    assert [c["count"] for c in wide["x"]["values"]] == [1, 0, 0, 2] and wide["x"].row_count == 3
    empty = df.limit(0)
    assert contingency(empty, "a", "b").count() == 0
