"""Significance tests as distributed aggregates with a one-row closing step.

* Chi-square test of independence: all tests share one scan; a grouped count
  gives the observed cells, windows over those few cells their margins, and
  ``chi2 = sum over observed of (o - e)^2 / e, plus n - sum over observed of e``
  (what the empty cells add), so no grid is built.  The Yates correction
  applies only when dof = 1, as in SciPy's ``chi2_contingency``.
  p = Q(dof/2, chi2/2), the regularized upper incomplete gamma function.
* Mann–Whitney U (two-sided; normal approximation with tie and continuity
  correction for large samples, as SciPy's ``auto`` method chooses): all variables share one pass;
  values are reduced to (variable, value, count in sample 1, count in sample
  2), running counts over the sorted distinct values give mid-ranks and both
  medians, and R1 = Σ n1(v)·midrank(v).  Where the smaller sample has at most
  ``EXACT_SAMPLE`` values and no two values are equal, the p-value is exact: the
  null distribution of U is counted by a recurrence over rows (one per value of
  U up to the observed tail).

P-values are column expressions over the one-row-per-test table: no Python
runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import cents
from ..operators.ordering import checkpointed, running_totals

SIGNIFICANCE = 0.05
#: fixed value: up to this size of the smaller sample, and without ties, the Mann–Whitney test is exact
EXACT_SAMPLE = 8


def erfc(x: Column) -> Column:
    """erfc of x >= 0: Taylor series below 2.5, continued fraction above."""
    def term(s: Column, k: Column) -> Column:
        t = s["t"] * (-x * x) / k
        return F.struct(t.alias("t"), (s["sum"] + t / (2 * k + 1)).alias("sum"))

    ks = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(ks, F.struct(x.alias("t"), x.alias("sum")), term, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), x, lambda acc, j: x + j / 2 / acc)
    return F.when(x < 2.5, 1 - series * (2 / math.sqrt(math.pi))).otherwise(
        F.exp(-x * x) / (fraction * math.sqrt(math.pi)))


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, Q(dof/2, x/2), as finite sums of
    terms kept as logarithms; NULL without degrees of freedom."""
    y = x.cast("double") / 2
    step = F.log(F.greatest(y, F.lit(1e-300)))

    def add(s: Column, divisor: Column) -> Column:
        log_t = s["t"] + step - F.log(divisor)
        return F.struct(log_t.alias("t"), (s["sum"] + F.exp(log_t)).alias("sum"))

    def terms(last: Column) -> Column:
        return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    even = F.aggregate(terms((F.floor(dof / 2) - 1).cast("int")), F.struct((-y).alias("t"), F.exp(-y).alias("sum")),
                       lambda s, i: add(s, i.cast("double")), lambda s: s["sum"])
    # odd: Q(1/2, y) = erfc(sqrt y), and y^a e^-y / gamma(a + 1) for a = 1/2, 3/2, ...
    half = step / 2 - y - math.log(math.sqrt(math.pi) / 2)
    first = F.when(dof >= 3, F.exp(half)).otherwise(0.0)
    odd = erfc(F.sqrt(y)) + F.aggregate(
        terms((F.floor((dof - 1) / 2) - 1).cast("int")), F.struct(half.alias("t"), first.alias("sum")),
        lambda s, i: add(s, i + 0.5), lambda s: s["sum"])
    p = F.when(y <= 0, F.lit(1.0)).otherwise(F.when(dof % 2 == 0, even).otherwise(odd))
    return F.when(dof > 0, F.least(F.lit(1.0), p))


def normal_two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


def _sums(measures: tuple[str, ...]) -> list[Column]:
    return [F.sum(m).alias(m) for m in measures]


def crosstab_map(df: DataFrame, row: str, col: str, measures: tuple[str, ...] = ("count",)) -> DataFrame:
    """Contingency table with one row per row value and its cells as a map.

    ``df`` has the measures as columns to be summed.  Column values are found
    by a sub-query over the grouped cells, so none is named beforehand; ``cells``
    maps each of them, in order, to its sums, 0 where the combination does not
    occur, and ``row_*``, ``all_*`` and ``columns`` (value and sums) are the
    margins.  NULL is a value like any other.  The distinct combinations are
    frozen; the columns must fit one row, as in any pivot.
    """
    grouped = checkpointed(df.groupBy(F.col(row).alias("row_value"), F.col(col).alias("col_value")).agg(*_sums(measures)))
    by_col = grouped.groupBy("col_value").agg(*_sums(measures))
    columns = by_col.agg(F.sort_array(F.collect_list(F.struct("col_value", *measures)))).scalar()
    own = F.map_from_entries(F.collect_list(F.struct(F.struct("col_value"), F.struct(*measures))))
    rows = grouped.groupBy("row_value").agg(own.alias("own"), *[F.sum(m).alias(f"row_{m}") for m in measures])
    rows = rows.withColumn("columns", columns)
    cells = F.transform("columns", lambda c: F.struct(
        F.struct(c["col_value"].alias("col_value")).alias("key"),
        F.coalesce(F.try_element_at(F.col("own"), F.struct(c["col_value"].alias("col_value"))),
                   F.struct(*[F.lit(0).cast("bigint").alias(m) for m in measures])).alias("value")))

    def over_columns(measure: str) -> Column:
        return F.aggregate("columns", F.lit(0).cast("bigint"), lambda acc, c: acc + c[measure]).alias(f"all_{measure}")

    whole = [over_columns(m) for m in measures]
    return rows.select("row_value", F.map_from_entries(cells).alias("cells"), *[f"row_{m}" for m in measures], "columns", *whole)


def contingency(df: DataFrame, row: str, col: str, measures: tuple[str, ...] = ("count",)) -> DataFrame:
    """The same in long form: row_value, col_value, the sums of the cell, and row_*, col_* and all_* margins; every
    combination of a row and a column value has a row."""
    wide = crosstab_map(df, row, col, measures)
    long = wide.select("*", F.explode("columns").alias("c")).withColumn("cell", F.col("cells")[F.struct(F.col("c.col_value").alias("col_value"))])
    return long.select("row_value", F.col("c.col_value").alias("col_value"), *[F.col(f"cell.{m}").alias(m) for m in measures],
                       *[f"row_{m}" for m in measures], *[F.col(f"c.{m}").alias(f"col_{m}") for m in measures],
                       *[f"all_{m}" for m in measures])


def st_crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts by row and column value, with the margins of both."""
    return contingency(df.withColumn("count", F.lit(1).cast("bigint")), row, col).select(
        "row_value", "col_value", "count", F.col("row_count").alias("row_total"), F.col("col_count").alias("col_total"),
        F.col("all_count").alias("total")).orderBy("row_value", "col_value")


def chi_squares(df: DataFrame, tests: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per test name: independence of a row and a column variable, NULLs left out."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("test"), F.col(r).cast("string").alias("r"), F.col(c).cast("string").alias("c"))
        for name, (r, c) in tests.items()])).alias("p")
    cells = (df.select(pairs).select("p.test", "p.r", "p.c").where(F.col("r").isNotNull() & F.col("c").isNotNull())
             .groupBy("test", "r", "c").agg(F.count(F.lit(1)).alias("o")))
    return chi_squares_of_cells(cells)


def chi_squares_of_cells(cells: DataFrame) -> DataFrame:
    """The same from observed cells: test, r, c and their positive count o."""
    cells = cells.withColumn("o", F.col("o").cast("double"))
    of_row, of_col, of_test = Window.partitionBy("test", "r"), Window.partitionBy("test", "c"), Window.partitionBy("test")
    # the share of a margin that falls to one of its observed cells, so that sums over cells count it once
    full = (cells.withColumns({"rt": F.sum("o").over(of_row), "in_row": F.count(F.lit(1)).over(of_row)})
            .withColumns({"ct": F.sum("o").over(of_col), "in_col": F.count(F.lit(1)).over(of_col)})
            .withColumn("n", F.sum("o").over(of_test))
            .withColumn("e", F.col("rt") * (F.col("ct") / F.col("n"))))
    gap = F.col("o") - F.col("e")
    sums = full.groupBy("test").agg(
        F.first("n").alias("n"), F.sum("e").alias("seen"), F.sum(gap * (gap / F.col("e"))).alias("part"),
        F.max(F.abs(gap)).alias("gap"),
        F.round(F.sum(1 / F.col("in_row"))).alias("rows"), F.round(F.sum(1 / F.col("in_col"))).alias("cols"),
        F.sum(1 / (F.col("rt") * F.col("in_row"))).alias("inv_rows"), F.sum(1 / (F.col("ct") * F.col("in_col"))).alias("inv_cols"))
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("bigint")
    corrected = F.greatest(F.col("gap") - 0.5, F.lit(0.0))  # the same in all four cells
    yates = corrected * corrected * (F.col("n") * F.col("inv_rows") * F.col("inv_cols"))
    plain = F.col("part") + (F.col("n") - F.col("seen"))
    stat = sums.select("test", dof.alias("dof"), F.round(F.when(dof == 1, yates).otherwise(plain), 6).alias("chi2"))
    return stat.select("test", "chi2", "dof", F.round(chi2_sf(F.col("chi2"), F.col("dof")), 10).alias("p_value")).withColumn(
        "significant", F.col("p_value") < SIGNIFICANCE)


def chi_square(df: DataFrame, row: str, col: str, test: str | None = None) -> DataFrame:
    return chi_squares(df, {test or f"{row} x {col}": (row, col)})


def st_chi_square(staging: DataFrame) -> DataFrame:
    return chi_squares(staging, {
        "contract_type vs churn": ("contract_type", "churn"), "internet_service vs churn": ("internet_service", "churn")})


def mann_whitneys(df: DataFrame, variables: dict[str, tuple[Column, int]], in_first: Column) -> DataFrame:
    """One row per variable: two-sided Mann–Whitney U of an integer value (and the
    divisor that turns it into its unit) between rows where ``in_first`` is true
    (sample 1) and false (sample 2)."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("variable"), v.cast("bigint").alias("v"), F.lit(d).alias("divisor"), in_first.alias("g"))
        for name, (v, d) in variables.items()])).alias("x")
    x = df.select(stacked).select("x.*").where(F.col("v").isNotNull() & F.col("g").isNotNull())
    per_value = x.groupBy("variable", "divisor", "v").agg(
        F.count_if(F.col("g")).alias("n1v"), F.count_if(~F.col("g")).alias("n2v")
    ).withColumn("t", F.col("n1v") + F.col("n2v"))
    ranked = running_totals(per_value, [F.col("v").asc()], {"cum": "t", "cum1": "n1v", "cum2": "n2v"}, ["variable"])
    wide = "decimal(38,0)"
    before = (F.col("cum") - F.col("t")).cast(wide)

    def place(cum: str, n: Column) -> Column:
        """The smallest value up to which there are more than ``n`` of a sample."""
        return F.min(F.when(F.col(cum) > n, F.col("v")))

    middles = []
    for i in (1, 2):
        n = F.col(f"cum{i}_total")
        middles += [place(f"cum{i}", F.floor((n - 1) / 2)).alias(f"low{i}"), place(f"cum{i}", F.floor(n / 2)).alias(f"high{i}")]
    agg = ranked.groupBy("variable", "divisor").agg(
        F.sum(F.col("n1v").cast(wide) * (before * 2 + F.col("t") + 1)).alias("r1x2"),  # 2·R1
        F.sum(F.col("t").cast(wide) * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
        F.sum("n1v").alias("n1"), F.sum("n2v").alias("n2"), *middles)
    n1, n2 = F.col("n1").cast(wide), F.col("n2").cast(wide)
    n = n1 + n2
    u1x2 = F.col("r1x2") - n1 * (n1 + 1)  # 2·U1
    u2x2 = n1 * n2 * 2 - u1x2
    big = F.greatest(u1x2, u2x2).cast("double") / 2.0
    mu = (n1 * n2).cast("double") / 2.0
    sigma = F.sqrt(
        (n1 * n2).cast("double") / 12.0
        * ((n + 1).cast("double") - F.col("ties").cast("double") / (n * (n - 1)).cast("double"))
    )
    z = F.when(sigma > 0, (big - mu - 0.5) / sigma)
    agg = checkpointed(agg)  # a row for each variable
    out = agg.select(
        "variable", F.col("n1").alias("n_first"), F.col("n2").alias("n_second"),
        (u1x2.cast("double") / 2.0).alias("u_statistic"), F.round(z, 10).alias("z"),
        *[((F.col(f"low{i}") + F.col(f"high{i}")).cast("double") / (2 * F.col("divisor")).cast("double")).alias(f"median_{name}")
          for i, name in ((1, "first"), (2, "second"))])
    approximate = normal_two_sided_p(F.col("z"))
    few = agg.where((F.least("n1", "n2") <= EXACT_SAMPLE) & (F.least("n1", "n2") > 0) & (F.col("ties") == 0))
    if few.isEmpty():
        out = out.withColumn("p", approximate)
    else:
        tail = few.select("variable", F.least("n1", "n2").cast("int").alias("m"), F.greatest("n1", "n2").cast("bigint").alias("n"),
                          (F.least(u1x2, u2x2) / 2).cast("bigint").alias("u"))
        out = out.join(F.broadcast(exact_two_sided_p(tail)), "variable", "left").withColumn("p", F.coalesce("exact", approximate))
    return out.withColumn("p_value", F.round("p", 10)).drop("p", "exact").withColumn(
        "significant", F.col("p_value") < SIGNIFICANCE)


def exact_two_sided_p(tail: DataFrame) -> DataFrame:
    """variable and exact: P(U <= u or as far on the other side) for samples of m <= ``EXACT_SAMPLE`` and n values
    without ties, from rows variable, m, n, u (the smaller U).

    The number of orders in which U takes the value i is the coefficient of q^i in
    the product over j = 1..m of (1 - q^(n+j)) / (1 - q^j).  Round j divides by a
    running sum over rows of one residue modulo j and multiplies by a join with
    the row n + j places before.  The work is m rounds over u + 1 <= m n / 2 + 1 rows.
    """
    counts = tail.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("u"))).alias("i"))
    counts = counts.withColumn("a", F.when(F.col("i") == 0, 1.0).otherwise(0.0))
    largest = tail.agg(F.max("m")).first()[0]
    for j in range(1, largest + 1):
        upto = Window.partitionBy("variable", F.pmod("i", F.lit(j))).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        divided = counts.withColumn("d", F.sum("a").over(upto))
        back = divided.select(F.col("variable").alias("v"), (F.col("i") + F.col("n") + j).alias("at"), F.col("d").alias("minus"))
        joined = divided.join(back, (divided["variable"] == back["v"]) & (divided["i"] == back["at"]), "left")
        counts = checkpointed(joined.select(
            "variable", "m", "n", "u", "i",
            F.when(F.col("m") >= j, F.col("d") - F.coalesce("minus", F.lit(0.0))).otherwise(F.col("a")).alias("a")))
    orders = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(1.0), lambda acc, j: acc * (F.col("n") + j) / j)
    return counts.groupBy("variable", "m", "n").agg(F.sum("a").alias("a")).select(
        "variable", F.least(F.lit(1.0), 2 * F.col("a") / orders).alias("exact"))


def mann_whitney(df: DataFrame, value: Column, in_first: Column, variable: str, divisor: int = 1) -> DataFrame:
    return mann_whitneys(df, {variable: (value, divisor)}, in_first)


def st_mann_whitney(staging: DataFrame) -> DataFrame:
    return mann_whitneys(staging, {
        "monthly_charges": (cents(F.col("monthly_charges")), 100), "tenure_months": (F.col("tenure_months"), 1)},
        F.col("churn") == "Yes")
