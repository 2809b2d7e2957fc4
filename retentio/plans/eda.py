"""Exploratory datasets: the numbers behind the distribution, category,
box-plot, outlier, correlation, scatter and add-on charts (drawing is left to
the consumer).

All statistics are exact: values are scaled to integers (cents, months,
0/1 flags), sums are integer, quartiles are picked by distributed order
statistics, and every division happens once at the end.  Small per-group
tables (ranges, quartiles) are broadcast back to the rows; they hold one row
per (variable, group) whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rounding import cents, pct, ratio, round_units, scaled
from ..operators.ordering import checkpointed
from ..operators.percentiles import order_statistics_of, value_table

# --- fixed values ---------------------------------------------------------------
# Categorical variables of the churn-by-category chart.
CATEGORY_VARIABLES = ["contract_type", "internet_service", "payment_method", "senior_citizen", "partner",
                      "paperless_billing"]
# Binary recoding for the correlation matrix, and the one-hot columns kept.
BINARY_CODES = {"Yes": 1, "No": 0, "Female": 1, "Male": 0}
CORRELATION_FEATURES = [
    "churn", "tenure_months", "monthly_charges", "total_charges", "senior_citizen", "partner", "dependents",
    "total_addons", "internet_Fiber optic", "internet_No", "contract_Month-to-month", "contract_Two year",
]
HIGH_CHURN_PCT = 30
# Numeric variables: name → scale (integer units per value).
NUMERIC_VARIABLES = [("tenure_months", 0), ("monthly_charges", 2), ("total_charges", 2)]
# ---------------------------------------------------------------------------------


def eda_frame(staging: DataFrame) -> DataFrame:
    """Staging plus the two derived EDA columns (is_churned, total_addons)."""
    return staging.drop("loaded_at").withColumns(
        {"is_churned": F.col("churn") == "Yes", "total_addons": R.total_addons()}
    )


def _units(col: str, scale: int) -> Column:
    c = F.col(col)
    return cents(c) if scale == 2 else c.cast("bigint")


def _numeric_long(df: DataFrame) -> DataFrame:
    """(variable, scale, v, is_churned) — one stack pass over the three numeric columns."""
    args = ", ".join(f"'{n}', {s}, `_{n}`" for n, s in NUMERIC_VARIABLES)
    return df.select(
        "is_churned", *[_units(n, s).alias(f"_{n}") for n, s in NUMERIC_VARIABLES]
    ).select("is_churned", F.expr(f"stack({len(NUMERIC_VARIABLES)}, {args}) AS (variable, scale, v)"))


def eda_histogram(staging: DataFrame, bins: int = 30) -> DataFrame:
    """Bin counts per variable and churn group; each group's bins span its own
    min–max, the last bin is closed (numpy's rule)."""
    long = _numeric_long(eda_frame(staging)).where(F.col("v").isNotNull())
    ranges = long.groupBy("variable", "scale", "is_churned").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.col("hi") - F.col("lo")
    # exact integer floor((v - lo) * bins / width), capped so the maximum lands in the last bin
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(((F.col("v") - F.col("lo")) * bins - F.pmod((F.col("v") - F.col("lo")) * bins, width)) / width,
                F.lit(bins - 1))
    ).cast("int")
    counts = (
        long.join(F.broadcast(ranges), ["variable", "scale", "is_churned"])
        .groupBy("variable", "is_churned", b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    unit = F.pow(F.lit(10.0), F.col("scale"))
    edge = lambda i: (F.col("lo") * bins + width * i).cast("double") / (F.lit(float(bins)) * unit)
    return (
        grid.join(counts, ["variable", "is_churned", "bin"], "left")
        .select(
            "variable", F.col("is_churned").alias("churned"), "bin",
            edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
            F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        )
        .orderBy("variable", "churned", "bin")
    )


def eda_churn_by_category(staging: DataFrame) -> DataFrame:
    f = eda_frame(staging)
    args = ", ".join(f"'{c}', `{c}`" for c in CATEGORY_VARIABLES)
    long = f.select("is_churned", F.expr(f"stack({len(CATEGORY_VARIABLES)}, {args}) AS (variable, value)"))
    g = long.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("is_churned")).alias("churned")
    )
    return g.select(
        "variable", "value", "customers", "churned",
        ((F.col("churned") * 100).cast("double") / F.col("customers").cast("double")).alias("churn_rate_pct"),
        (F.col("churned") * 100 > F.col("customers") * HIGH_CHURN_PCT).alias("above_threshold"),
    ).orderBy(
        "variable", F.desc("churned"), "value"
    )


def box_stats(long: DataFrame, group: list[str]) -> DataFrame:
    """Quartiles, IQR fences, whiskers and outliers of integer ``v`` per group.

    Quartiles are kept as 4×q (integers) and fences as 8×fence, so the
    membership tests are exact integer comparisons."""
    values = checkpointed(value_table(long, "v", group))  # the only pass over the rows
    q = order_statistics_of(values, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, group)

    def four(name: str) -> Column:
        lo, hi, f, b = (F.col(f"{name}_{s}") for s in ("lo", "hi", "f", "b"))
        return lo * 4 + f * (hi - lo) * (F.lit(4) / b).cast("bigint")

    q = q.select(*group, "n", four("q1").alias("_q1"), four("q2").alias("_q2"), four("q3").alias("_q3"))
    q = q.withColumns({
        "_l8": F.col("_q1") * 2 - (F.col("_q3") - F.col("_q1")) * 3,
        "_u8": F.col("_q3") * 2 + (F.col("_q3") - F.col("_q1")) * 3,
    })
    x8 = F.col("v") * 8
    inside = (x8 >= F.col("_l8")) & (x8 <= F.col("_u8"))
    w = (
        values.join(q.select(*group, "_l8", "_u8"), group)
        .groupBy(*group)
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("_lw"),
            F.max(F.when(inside, F.col("v"))).alias("_uw"),
            F.coalesce(F.sum(F.when(~inside, F.col("_cnt"))), F.lit(0)).alias("outliers"),
        )
    )
    return q.join(w, group)


def _box_out(stats: DataFrame, group: list[str], unit: Column) -> DataFrame:
    u = unit.cast("double")
    return stats.select(
        *group, "n",
        (F.col("_q1").cast("double") / (u * 4)).alias("q1"),
        (F.col("_q2").cast("double") / (u * 4)).alias("median"),
        (F.col("_q3").cast("double") / (u * 4)).alias("q3"),
        ((F.col("_q3") - F.col("_q1")).cast("double") / (u * 4)).alias("iqr"),
        (F.col("_l8").cast("double") / (u * 8)).alias("lower_fence"),
        (F.col("_u8").cast("double") / (u * 8)).alias("upper_fence"),
        (F.col("_lw").cast("double") / u).alias("lower_whisker"),
        (F.col("_uw").cast("double") / u).alias("upper_whisker"),
        "outliers",
    )


def eda_box_stats(staging: DataFrame) -> DataFrame:
    """Box-plot numbers: monthly charges by churn, by contract and overall;
    total charges overall (one stack pass)."""
    f = eda_frame(staging).select(
        cents(F.col("monthly_charges")).alias("m"), cents(F.col("total_charges")).alias("t"), "churn", "contract_type"
    )
    long = f.select(F.expr(
        "stack(4, 'monthly_charges', 'churn', churn, m, 'monthly_charges', 'contract_type', contract_type, m, "
        "'monthly_charges', 'all', 'all', m, 'total_charges', 'all', 'all', t) AS (variable, group_by, group_value, v)"
    )).where(F.col("v").isNotNull())
    group = ["variable", "group_by", "group_value"]
    return _box_out(box_stats(long, group), group, F.lit(100)).orderBy(*group)


def eda_iqr_outliers(staging: DataFrame) -> DataFrame:
    """Q1, Q3, IQR, fences, outlier count and % of non-null values per numeric column."""
    long = _numeric_long(eda_frame(staging)).where(F.col("v").isNotNull())
    stats = box_stats(long, ["variable", "scale"])
    out = _box_out(stats, ["variable", "scale"], F.pow(F.lit(10), F.col("scale")))
    return out.select(
        "variable", "q1", "q3", "iqr", "lower_fence", "upper_fence", "outliers",
        ((F.col("outliers") * 100).cast("double") / F.col("n").cast("double")).alias("outlier_pct"),
    ).orderBy("variable")


# Features held in cents; their sums are kept in decimal so they cannot overflow.
_MONEY_FEATURES = {"monthly_charges", "total_charges"}


def correlation_features(staging: DataFrame) -> DataFrame:
    """The twelve correlation features as integers (NULL where unmapped/missing)."""
    f = eda_frame(staging)

    def code(c: str) -> Column:
        e = None
        for k, v in BINARY_CODES.items():
            e = F.when(F.col(c) == k, F.lit(v)) if e is None else e.when(F.col(c) == k, F.lit(v))
        return e

    cols = {
        "churn": code("churn"),
        "tenure_months": F.col("tenure_months"),
        "monthly_charges": cents(F.col("monthly_charges")),
        "total_charges": cents(F.col("total_charges")),
        "senior_citizen": code("senior_citizen"),
        "partner": code("partner"),
        "dependents": code("dependents"),
        "total_addons": F.col("total_addons"),
        "internet_Fiber optic": (F.col("internet_service") == "Fiber optic").cast("int"),
        "internet_No": (F.col("internet_service") == "No").cast("int"),
        "contract_Month-to-month": (F.col("contract_type") == "Month-to-month").cast("int"),
        "contract_Two year": (F.col("contract_type") == "Two year").cast("int"),
    }
    return f.select(*[
        cols[k].cast("decimal(20,0)" if k in _MONEY_FEATURES else "bigint").alias(k) for k in CORRELATION_FEATURES
    ])


def correlation_pairs(staging: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson r per pair over the rows where both values are present (pandas'
    pairwise-complete rule), exact, in one pass over the data.

    The rows are first grouped by their small-valued features (some ten
    thousand combinations), with n, Σx, Σx² and Σxy of the two money columns:
    six sums per row.  All other sums follow from those groups, which are
    grouped once more by their pattern of missing features; the pairwise
    moments are sums over the patterns in which both features are present."""
    x = correlation_features(staging)
    feats = [f for f in CORRELATION_FEATURES if any(f in p for p in pairs)]
    bit = {f: 1 << i for i, f in enumerate(feats)}
    q = lambda f: F.col(f"`{f}`")
    coins = [f for f in feats if f in _MONEY_FEATURES]
    present = [q(f).isNotNull().alias(f"_has_{f}") for f in coins]
    grouped = x.groupBy(*[q(f) for f in feats if f not in coins], *present).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(q(f)).alias(f"_s_{f}") for f in coins],
        *[F.sum(q(a) * q(b)).alias(f"_p_{a}_{b}") for i, a in enumerate(coins) for b in coins[i:]],
    )
    wide = "decimal(38,0)"

    def has(f: str) -> Column:
        return F.col(f"`_has_{f}`") if f in coins else q(f).isNotNull()

    def total(f: str) -> Column:
        return F.col(f"`_s_{f}`").cast(wide) if f in coins else (F.col("_n") * q(f)).cast(wide)

    def product(a: str, b: str) -> Column:
        if a in coins and b in coins:
            a, b = sorted((a, b), key=coins.index)
            return F.col(f"`_p_{a}_{b}`").cast(wide)
        if a in coins or b in coins:
            coin, other = (a, b) if a in coins else (b, a)
            return F.col(f"`_s_{coin}`").cast(wide) * q(other)
        return (F.col("_n") * q(a) * q(b)).cast(wide)

    pattern = sum((F.when(has(f), F.lit(bit[f])).otherwise(F.lit(0)) for f in feats), F.lit(0))
    per_pattern = grouped.groupBy(pattern.alias("_pat")).agg(
        F.sum("_n").alias("_n"),
        *[F.sum(total(f)).alias(f"s{bit[f]}") for f in feats],
        *[F.sum(product(f, f)).alias(f"q{bit[f]}") for f in feats],
        *[F.sum(product(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
    )
    # one row per (pair, pattern) where both features are present, then 6 sums per pair
    parts = []
    for i, (a, b) in enumerate(pairs):
        mask = bit[a] | bit[b]
        parts.append(F.when(
            F.col("_pat").bitwiseAND(F.lit(mask)) == mask,
            F.struct(
                F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col("_n").alias("n"),
                F.col(f"s{bit[a]}").alias("sa"), F.col(f"s{bit[b]}").alias("sb"), F.col(f"p{i}").alias("sab"),
                F.col(f"q{bit[a]}").alias("saa"), F.col(f"q{bit[b]}").alias("sbb"),
            ).cast(_MOMENTS),
        ))
    long = per_pattern.select(F.explode(F.array(*parts)).alias("m")).where(F.col("m").isNotNull()).select("m.*")
    m = long.groupBy("feature_a", "feature_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    num = n * F.col("sab") - sa * sb
    da = n * F.col("saa") - sa * sa
    db = n * F.col("sbb") - sb * sb
    r = F.when((da > 0) & (db > 0), num.cast("double") / F.sqrt(da.cast("double") * db.cast("double")))
    order = {p: i for i, p in enumerate(pairs)}
    pos = F.create_map(*[x for (a, b), i in order.items() for x in (F.lit(f"{a}|{b}"), F.lit(i))])
    return m.select("feature_a", "feature_b", F.round(r, 10).alias("correlation"),
                    pos[F.concat_ws("|", "feature_a", "feature_b")].alias("_i")).orderBy("_i").drop("_i")


_MOMENTS = (
    "struct<feature_a:string,feature_b:string,n:decimal(38,0),sa:decimal(38,0),sb:decimal(38,0),"
    "sab:decimal(38,0),saa:decimal(38,0),sbb:decimal(38,0)>"
)


def lower_triangle(features: list[str]) -> list[tuple[str, str]]:
    return [(features[i], features[j]) for i in range(len(features)) for j in range(i)]


def eda_correlation(staging: DataFrame) -> DataFrame:
    return correlation_pairs(staging, lower_triangle(CORRELATION_FEATURES))


def eda_churn_drivers(staging: DataFrame) -> DataFrame:
    pairs = [(f, "churn") for f in CORRELATION_FEATURES if f != "churn"]
    c = correlation_pairs(staging, pairs)
    return c.select(
        F.col("feature_a").alias("feature"), "correlation",
        F.when(F.col("correlation") > 0, F.lit("+")).otherwise(F.lit("-")).alias("direction"),
    ).orderBy(F.abs("correlation").desc(), "feature")


def eda_scatter_bins(staging: DataFrame, charge_step: float = 5.0) -> DataFrame:
    """Tenure × monthly-charge 2-D counts by churn (the scatter at any scale)."""
    step_c = int(round(charge_step * 100))
    m = cents(F.col("monthly_charges"))
    lo_c = (m - F.pmod(m, F.lit(step_c)))
    return (
        eda_frame(staging)
        .groupBy("tenure_months", lo_c.alias("_lo"), F.col("is_churned").alias("churned"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .select("tenure_months", (F.col("_lo").cast("double") / 100.0).alias("charge_bin_lo"), "churned", "customers")
        .orderBy("tenure_months", "charge_bin_lo", "churned")
    )


def eda_addon_stickiness(staging: DataFrame) -> DataFrame:
    g = eda_frame(staging).groupBy("total_addons").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("is_churned")).alias("churned")
    )
    return g.select(
        "total_addons", "customers",
        ((F.col("churned") * 100).cast("double") / F.col("customers").cast("double")).alias("churn_rate_pct"),
        (F.col("churned") * 100 > F.col("customers") * HIGH_CHURN_PCT).alias("above_threshold"),
    ).orderBy("total_addons")


def eda_summary(staging: DataFrame) -> DataFrame:
    f = eda_frame(staging)
    a = f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("is_churned")).alias("_ch"),
        F.min("tenure_months").alias("min_tenure"), F.max("tenure_months").alias("max_tenure"),
        F.sum("tenure_months").alias("_t"),
        F.min("monthly_charges").alias("_minm"), F.max("monthly_charges").alias("_maxm"),
        F.sum(cents(F.col("monthly_charges"))).alias("_m"),
        F.min("total_charges").alias("_mint"), F.max("total_charges").alias("_maxt"),
        F.count_if(F.col("total_charges").isNull()).alias("null_total_charges"),
    )
    return a.select(
        "n_rows", F.lit(len(f.columns)).cast("bigint").alias("n_columns"),
        pct(F.col("_ch"), F.col("n_rows")).alias("churn_rate_pct"),
        "min_tenure", "max_tenure", ratio(F.col("_t"), F.col("n_rows"), 1).alias("mean_tenure"),
        F.col("_minm").cast("double").alias("min_monthly"), F.col("_maxm").cast("double").alias("max_monthly"),
        scaled(round_units(F.col("_m"), F.col("n_rows"), 1), 2).alias("mean_monthly"),
        F.col("_mint").cast("double").alias("min_total"), F.col("_maxt").cast("double").alias("max_total"),
        "null_total_charges",
    )
