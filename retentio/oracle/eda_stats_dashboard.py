"""Oracle SQL for the EDA datasets, the chi-square test and the dashboard datasets."""

from __future__ import annotations

from .base import avg_money, cents, money, pct, ratio, scaled, units, with_ctes
from .sqlgen import order_stats_cte, q_value

Q: dict[str, str] = {}

# --- fixed values: variables and features of the datasets
CATEGORY_VARIABLES = [
    "contract_type", "internet_service", "payment_method", "senior_citizen", "partner", "paperless_billing",
]
CORRELATION_FEATURES = [
    "churn", "tenure_months", "monthly_charges", "total_charges", "senior_citizen", "partner", "dependents",
    "total_addons", "internet_Fiber optic", "internet_No", "contract_Month-to-month", "contract_Two year",
]

EF = """
, ef AS (
    SELECT *, churn = 'Yes' AS is_churned,
           CAST((CASE WHEN multiple_lines = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN online_security = 'Yes' THEN 1 ELSE 0 END)
              + (CASE WHEN online_backup = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN device_protection = 'Yes' THEN 1 ELSE 0 END)
              + (CASE WHEN tech_support = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN streaming_tv = 'Yes' THEN 1 ELSE 0 END)
              + (CASE WHEN streaming_movies = 'Yes' THEN 1 ELSE 0 END) AS INTEGER) AS total_addons
    FROM stg
),
nlong AS (
    SELECT 'tenure_months' AS variable, 0 AS scale, CAST(tenure_months AS BIGINT) AS v, is_churned FROM ef
    UNION ALL SELECT 'monthly_charges', 2, CAST(monthly_charges * 100 AS BIGINT), is_churned FROM ef
    UNION ALL SELECT 'total_charges', 2, CAST(total_charges * 100 AS BIGINT), is_churned FROM ef
)"""

Q["eda_histogram"] = EF + """,
l2 AS (SELECT * FROM nlong WHERE v IS NOT NULL),
ranges AS (SELECT variable, scale, is_churned, MIN(v) AS lo, MAX(v) AS hi FROM l2 GROUP BY variable, scale, is_churned),
counts AS (
    SELECT l2.variable, l2.is_churned,
           CAST(CASE WHEN hi = lo THEN 0 ELSE least(((v - lo) * 30) // (hi - lo), 29) END AS INTEGER) AS bin,
           COUNT(*) AS cnt
    FROM l2 JOIN ranges r ON r.variable = l2.variable AND r.scale = l2.scale AND r.is_churned = l2.is_churned
    GROUP BY 1, 2, 3
),
grid AS (SELECT r.*, CAST(t.b AS INTEGER) AS bin FROM ranges r, range(30) t(b))
SELECT g.variable, g.is_churned AS churned, g.bin,
       CAST(lo * 30 + (hi - lo) * g.bin AS DOUBLE) / (30.0 * pow(10, scale)) AS bin_lo,
       CAST(lo * 30 + (hi - lo) * (g.bin + 1) AS DOUBLE) / (30.0 * pow(10, scale)) AS bin_hi,
       COALESCE(cnt, 0) AS count
FROM grid g LEFT JOIN counts c ON c.variable = g.variable AND c.is_churned = g.is_churned AND c.bin = g.bin
ORDER BY 1, 2, 3"""

Q["eda_churn_by_category"] = EF + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, {c} AS value, COUNT(*) AS customers, COUNT(*) FILTER (WHERE is_churned) AS churned, "
    f"CAST(COUNT(*) FILTER (WHERE is_churned) * 100 AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS churn_rate_pct, "
    f"COUNT(*) FILTER (WHERE is_churned) * 100 > COUNT(*) * 30 AS above_threshold FROM ef GROUP BY {c}"
    for c in CATEGORY_VARIABLES
)


def _box(source: str, group: list[str], unit: str, extra_select: str | None = None) -> str:
    gl = ", ".join(group)
    on = " AND ".join(f"l.{g} = s.{g}" for g in group)
    four = lambda q: f"({q}_lo * 4 + {q}_f * ({q}_hi - {q}_lo) * (4 // {q}_b))"
    return f""",
{order_stats_cte('os', source, 'v', {'q1': 0.25, 'q2': 0.5, 'q3': 0.75}, group)},
s AS (
    SELECT {gl}, n, {four('q1')} AS _q1, {four('q2')} AS _q2, {four('q3')} AS _q3,
           {four('q1')} * 2 - ({four('q3')} - {four('q1')}) * 3 AS _l8,
           {four('q3')} * 2 + ({four('q3')} - {four('q1')}) * 3 AS _u8
    FROM os
),
w AS (
    SELECT {', '.join('l.' + g for g in group)},
           MIN(v) FILTER (WHERE v * 8 >= _l8 AND v * 8 <= _u8) AS _lw,
           MAX(v) FILTER (WHERE v * 8 >= _l8 AND v * 8 <= _u8) AS _uw,
           COUNT(*) FILTER (WHERE NOT (v * 8 >= _l8 AND v * 8 <= _u8)) AS outliers
    FROM {source} l JOIN s ON {on} GROUP BY {', '.join('l.' + g for g in group)}
),
b AS (
    SELECT s.*, w._lw, w._uw, w.outliers, CAST({unit} AS DOUBLE) AS u
    FROM s JOIN w ON {' AND '.join(f's.{g} = w.{g}' for g in group)}
)
SELECT {extra_select or gl + ', n'},
       CAST(_q1 AS DOUBLE) / (u * 4) AS q1, CAST(_q2 AS DOUBLE) / (u * 4) AS median, CAST(_q3 AS DOUBLE) / (u * 4) AS q3,
       CAST(_q3 - _q1 AS DOUBLE) / (u * 4) AS iqr, CAST(_l8 AS DOUBLE) / (u * 8) AS lower_fence,
       CAST(_u8 AS DOUBLE) / (u * 8) AS upper_fence, CAST(_lw AS DOUBLE) / u AS lower_whisker,
       CAST(_uw AS DOUBLE) / u AS upper_whisker, outliers
FROM b"""


Q["eda_box_stats"] = EF + """,
blong AS (
    SELECT 'monthly_charges' AS variable, 'churn' AS group_by, churn AS group_value, CAST(monthly_charges * 100 AS BIGINT) AS v FROM ef
    UNION ALL SELECT 'monthly_charges', 'contract_type', contract_type, CAST(monthly_charges * 100 AS BIGINT) FROM ef
    UNION ALL SELECT 'monthly_charges', 'all', 'all', CAST(monthly_charges * 100 AS BIGINT) FROM ef
    UNION ALL SELECT 'total_charges', 'all', 'all', CAST(total_charges * 100 AS BIGINT) FROM ef WHERE total_charges IS NOT NULL
)""" + _box("blong", ["variable", "group_by", "group_value"], "100")

def _iqr() -> str:
    inner = EF + ",\nilong AS (SELECT variable, scale, v FROM nlong WHERE v IS NOT NULL)" + _box("ilong", ["variable", "scale"], "pow(10, s.scale)")
    head, tail = inner.rsplit("\nSELECT variable, scale, n,", 1)
    return (
        head + ",\nbx AS (SELECT variable, scale, n," + tail + ")\n"
        "SELECT variable, q1, q3, iqr, lower_fence, upper_fence, outliers, "
        "CAST(outliers * 100 AS DOUBLE) / CAST(n AS DOUBLE) AS outlier_pct FROM bx ORDER BY variable"
    )


Q["eda_iqr_outliers"] = _iqr()

_BIN = "CASE {c} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'Female' THEN 1 WHEN 'Male' THEN 0 END"
_FEATURE_SQL = {
    "churn": _BIN.format(c="churn"),
    "tenure_months": "tenure_months",
    "monthly_charges": cents("monthly_charges"),
    "total_charges": cents("total_charges"),
    "senior_citizen": _BIN.format(c="senior_citizen"),
    "partner": _BIN.format(c="partner"),
    "dependents": _BIN.format(c="dependents"),
    "total_addons": "total_addons",
    "internet_Fiber optic": "CASE WHEN internet_service = 'Fiber optic' THEN 1 ELSE 0 END",
    "internet_No": "CASE WHEN internet_service = 'No' THEN 1 ELSE 0 END",
    "contract_Month-to-month": "CASE WHEN contract_type = 'Month-to-month' THEN 1 ELSE 0 END",
    "contract_Two year": "CASE WHEN contract_type = 'Two year' THEN 1 ELSE 0 END",
}


def _corr_parts(pairs: list[tuple[str, str]]) -> tuple[str, str]:
    """(CTE text ending after the moments CTE ``m``, UNION ALL of one row per pair)."""
    feats = ", ".join(f'CAST({_FEATURE_SQL[f]} AS HUGEINT) AS "{f}"' for f in CORRELATION_FEATURES)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = f'"{a}" IS NOT NULL AND "{b}" IS NOT NULL'
        aggs += [
            f"COUNT(*) FILTER (WHERE {both}) AS n{i}", f'SUM("{a}") FILTER (WHERE {both}) AS a{i}',
            f'SUM("{b}") FILTER (WHERE {both}) AS b{i}', f'SUM("{a}" * "{b}") FILTER (WHERE {both}) AS ab{i}',
            f'SUM("{a}" * "{a}") FILTER (WHERE {both}) AS aa{i}', f'SUM("{b}" * "{b}") FILTER (WHERE {both}) AS bb{i}',
        ]
    rows = []
    for i, (a, b) in enumerate(pairs):
        num = f"(n{i} * ab{i} - a{i} * b{i})"
        da = f"(n{i} * aa{i} - a{i} * a{i})"
        db = f"(n{i} * bb{i} - b{i} * b{i})"
        r = f"CASE WHEN {da} > 0 AND {db} > 0 THEN CAST({num} AS DOUBLE) / sqrt(CAST({da} AS DOUBLE) * CAST({db} AS DOUBLE)) END"
        rows.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({r}, 10) AS correlation FROM m")
    ctes = f"{EF},\nx AS (SELECT {feats} FROM ef),\nm AS (SELECT {', '.join(aggs)} FROM x)"
    return ctes, "\nUNION ALL\n".join(rows)


_LOWER = [(CORRELATION_FEATURES[i], CORRELATION_FEATURES[j]) for i in range(len(CORRELATION_FEATURES)) for j in range(i)]
_ctes, _rows = _corr_parts(_LOWER)
Q["eda_correlation"] = f"{_ctes}\n{_rows}"
_ctes, _rows = _corr_parts([(f, "churn") for f in CORRELATION_FEATURES if f != "churn"])
Q["eda_churn_drivers"] = (
    f"{_ctes},\npairs AS ({_rows})\n"
    "SELECT feature_a AS feature, correlation, CASE WHEN correlation > 0 THEN '+' ELSE '-' END AS direction "
    "FROM pairs ORDER BY abs(correlation) DESC, feature"
)

Q["eda_scatter_bins"] = EF + """
SELECT tenure_months, CAST(CAST(monthly_charges * 100 AS BIGINT) - CAST(monthly_charges * 100 AS BIGINT) % 500 AS DOUBLE) / 100.0 AS charge_bin_lo,
       is_churned AS churned, COUNT(*) AS customers
FROM ef GROUP BY 1, 2, 3 ORDER BY 1, 2, 3"""

Q["eda_addon_stickiness"] = EF + """
SELECT total_addons, COUNT(*) AS customers,
       CAST(COUNT(*) FILTER (WHERE is_churned) * 100 AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS churn_rate_pct,
       COUNT(*) FILTER (WHERE is_churned) * 100 > COUNT(*) * 30 AS above_threshold
FROM ef GROUP BY total_addons ORDER BY total_addons"""

Q["eda_summary"] = EF + f"""
SELECT COUNT(*) AS n_rows, CAST(23 AS BIGINT) AS n_columns,
       {pct('COUNT(*) FILTER (WHERE is_churned)', 'COUNT(*)')} AS churn_rate_pct,
       MIN(tenure_months) AS min_tenure, MAX(tenure_months) AS max_tenure,
       {ratio('SUM(tenure_months)', 'COUNT(*)', 1)} AS mean_tenure,
       CAST(MIN(monthly_charges) AS DOUBLE) AS min_monthly, CAST(MAX(monthly_charges) AS DOUBLE) AS max_monthly,
       {scaled(units(f"SUM({cents('monthly_charges')})", 'COUNT(*)', 1), 2)} AS mean_monthly,
       CAST(MIN(total_charges) AS DOUBLE) AS min_total, CAST(MAX(total_charges) AS DOUBLE) AS max_total,
       COUNT(*) FILTER (WHERE total_charges IS NULL) AS null_total_charges
FROM ef"""

# --- statistical tests ------------------------------------------------------------

Q["st_crosstab"] = """
SELECT r.v AS row_value, k.v AS col_value, CAST(COUNT(*) FILTER (WHERE contract_type = r.v AND churn = k.v) AS BIGINT) AS count,
       CAST(COUNT(*) FILTER (WHERE contract_type = r.v) AS BIGINT) AS row_total,
       CAST(COUNT(*) FILTER (WHERE churn = k.v) AS BIGINT) AS col_total, COUNT(*) AS total
FROM (SELECT DISTINCT contract_type AS v FROM stg) AS r CROSS JOIN (SELECT DISTINCT churn AS v FROM stg) AS k CROSS JOIN stg
GROUP BY ALL"""


def _chi(row: str, col: str, name: str) -> str:
    return f"""
    SELECT '{name}' AS test, chi2, dof, round(exp(-chi2 / 2), 10) AS p_value, round(exp(-chi2 / 2), 10) < 0.05 AS significant
    FROM (
        SELECT CAST(dof AS BIGINT) AS dof, round(SUM(
                 CASE WHEN dof = 1
                      THEN CAST(greatest(abs(o * n - rt * ct) * 2 - n, 0) * greatest(abs(o * n - rt * ct) * 2 - n, 0) AS DOUBLE)
                           / CAST(n * rt * ct * 4 AS DOUBLE)
                      ELSE CAST((o * n - rt * ct) * (o * n - rt * ct) AS DOUBLE) / CAST(n * rt * ct AS DOUBLE) END), 6) AS chi2
        FROM (
            SELECT g.r, g.c, CAST(COALESCE(cl.o, 0) AS HUGEINT) AS o, CAST(g.rt AS HUGEINT) AS rt, CAST(g.ct AS HUGEINT) AS ct,
                   CAST(SUM(COALESCE(cl.o, 0)) OVER () AS HUGEINT) AS n,
                   (COUNT(DISTINCT g.r) OVER () - 1) * (COUNT(DISTINCT g.c) OVER () - 1) AS dof
            FROM (SELECT r, rt, c, ct FROM (SELECT {row} AS r, COUNT(*) AS rt FROM stg GROUP BY 1),
                                             (SELECT {col} AS c, COUNT(*) AS ct FROM stg GROUP BY 1)) g
            LEFT JOIN (SELECT {row} AS r, {col} AS c, COUNT(*) AS o FROM stg GROUP BY 1, 2) cl ON cl.r = g.r AND cl.c = g.c
        ) cells
        GROUP BY dof
    )"""


Q["st_chi_square"] = (
    "\n" + _chi("contract_type", "churn", "contract_type vs churn") + "\nUNION ALL\n"
    + _chi("internet_service", "churn", "internet_service vs churn")
)

# --- dashboard --------------------------------------------------------------------

N = "COUNT(*)"
CH = "COUNT(*) FILTER (WHERE is_churned)"
MRR = f"SUM({cents('monthly_charges')})"
RISK = f"SUM({cents('mrr_at_risk')})"

Q["db_overview_kpis"] = f"""
SELECT {N} AS customers, {pct(CH, N)} AS churn_rate_pct, {money(MRR)} AS total_mrr, {money(RISK)} AS mrr_at_risk,
       {avg_money(f"SUM({cents('estimated_clv')})", 'COUNT(estimated_clv)')} AS avg_clv,
       {ratio('SUM(tenure_months)', N, 1)} AS avg_tenure_months
FROM flat"""

Q["db_risk_share_by_contract"] = f"""
, g AS (SELECT contract_type, {RISK} AS r FROM flat GROUP BY contract_type)
SELECT contract_type, {money('r')} AS mrr_at_risk, {pct('r', 'SUM(r) OVER ()')} AS share_pct FROM g ORDER BY mrr_at_risk DESC"""

_DIMS = ["contract_type", "internet_service", "payment_method", "tenure_bucket"]
Q["db_vs_average"] = """
, g AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dimension, {d} AS value, COUNT(*) AS customers, COUNT(*) FILTER (WHERE is_churned) AS churned FROM flat GROUP BY {d}"
    for d in _DIMS
) + f"""),
o AS (SELECT {N} AS _n, {CH} AS _c FROM flat)
SELECT dimension, value, customers, {pct('churned', 'customers')} AS churn_rate_pct, {pct('_c', '_n')} AS overall_rate_pct,
       churned * _n > _c * customers AS above_average
FROM g, o ORDER BY dimension, value"""

Q["db_crosstab"] = f"""
, g AS (SELECT contract_type, internet_service, {N} AS n, {CH} AS c FROM flat GROUP BY ALL),
grid AS (
    SELECT contract_type, internet_service, coalesce(n, 0) AS n, coalesce(c, 0) AS c
    FROM (SELECT DISTINCT contract_type FROM g) CROSS JOIN (SELECT DISTINCT internet_service FROM g)
    LEFT JOIN g USING (contract_type, internet_service)),
m AS (
    SELECT *, SUM(n) OVER r AS rn, SUM(c) OVER r AS rc, SUM(n) OVER k AS kn, SUM(c) OVER k AS kc, SUM(n) OVER () AS an, SUM(c) OVER () AS ac
    FROM grid WINDOW r AS (PARTITION BY contract_type), k AS (PARTITION BY internet_service))
SELECT contract_type, internet_service, n AS customers, c AS churned, {pct('c', 'n')} AS churn_rate_pct,
       {pct('rc', 'rn')} AS contract_churn_rate_pct, {pct('kc', 'kn')} AS internet_churn_rate_pct, {pct('ac', 'an')} AS overall_churn_rate_pct
FROM m"""

Q["db_filtered"] = f"""
SELECT contract_type, {N} AS total_customers, {CH} AS churned, {pct(CH, N)} AS churn_rate_pct,
       {avg_money(MRR, N)} AS avg_monthly_charges, {money(MRR)} AS total_mrr
FROM flat WHERE dependents IN ('No') AND partner IN ('No') GROUP BY contract_type ORDER BY contract_type"""

_TWO = """
, long AS (
    SELECT 'contract_type' AS dimension, contract_type AS value, * EXCLUDE (contract_type) FROM flat
    UNION ALL BY NAME
    SELECT 'internet_tier' AS dimension, internet_tier AS value, * EXCLUDE (internet_tier) FROM flat
)"""

Q["db_mrr_split"] = _TWO + f"""
SELECT dimension, value,
       {money(f"COALESCE(SUM({cents('monthly_charges')}) FILTER (WHERE NOT is_churned), 0)")} AS retained_mrr,
       {money(f"COALESCE(SUM({cents('monthly_charges')}) FILTER (WHERE is_churned), 0)")} AS churned_mrr
FROM long GROUP BY dimension, value ORDER BY dimension, value"""

Q["db_clv_projection"] = _TWO + f"""
SELECT dimension, value, {avg_money(MRR, N)} AS avg_monthly_charges, {ratio('SUM(tenure_months)', N, 1)} AS avg_tenure_months,
       {scaled(units(f'CAST({MRR} AS HUGEINT) * SUM(tenure_months)', f'CAST({N} AS HUGEINT) * {N}', 1), 2)} AS projected_clv
FROM long GROUP BY dimension, value ORDER BY dimension, value"""

Q["db_charge_distribution"] = f"""
, g AS (
    SELECT {cents('monthly_charges')} - {cents('monthly_charges')} % 1000 AS lo, COUNT(*) AS customers,
           SUM({cents('monthly_charges')}) AS rev
    FROM flat GROUP BY 1
)
SELECT {money('lo')} AS bin_lo, {money('lo + 1000')} AS bin_hi, customers, {money('rev')} AS mrr,
       {pct('rev', 'SUM(rev) OVER ()')} AS revenue_share_pct,
       {pct('SUM(rev) OVER (ORDER BY lo)', 'SUM(rev) OVER ()')} AS cumulative_share_pct
FROM g ORDER BY bin_lo"""

TIER = """CASE WHEN is_churned THEN 'Churned'
               WHEN contract_type = 'Month-to-month' AND tenure_months <= 12 THEN 'High Risk'
               WHEN contract_type = 'Month-to-month' THEN 'Medium Risk' ELSE 'Low Risk' END"""

Q["db_risk_tiers"] = f"""
, g AS (SELECT {TIER} AS risk_tier, COUNT(*) AS customers, {MRR} AS m FROM flat GROUP BY 1)
SELECT risk_tier, customers, {pct('customers', 'SUM(customers) OVER ()')} AS pct_of_customers, {money('m')} AS total_mrr
FROM g ORDER BY risk_tier"""

Q["db_segment_table"] = f"""
, long AS (
    SELECT 'household_type' AS segment_type, household_type AS segment, is_churned, monthly_charges FROM flat
    UNION ALL SELECT 'senior_segment', senior_segment, is_churned, monthly_charges FROM flat
    UNION ALL SELECT 'addon_group', CASE WHEN total_addons >= 6 THEN '6+' ELSE CAST(total_addons AS VARCHAR) END,
                     is_churned, monthly_charges FROM flat
)
SELECT segment_type, segment, {N} AS customers, {pct(CH, N)} AS churn_rate_pct, {money(MRR)} AS total_mrr
FROM long GROUP BY segment_type, segment ORDER BY segment_type, segment"""

_SERVICES = [
    ("Phone Service", "phone_service"), ("Multiple Lines", "multiple_lines"),
    ("Online Security", "online_security"), ("Online Backup", "online_backup"),
    ("Device Protection", "device_protection"), ("Tech Support", "tech_support"),
    ("Streaming TV", "streaming_tv"), ("Streaming Movies", "streaming_movies"),
]
SLONG = ", slong AS (" + "\nUNION ALL\n".join(
    f"SELECT '{label}' AS service_name, {col} AS subscribed, is_churned FROM flat" for label, col in _SERVICES
) + ")"

_LIFT = f"""
, lift AS (
    SELECT service_name, COUNT(*) FILTER (WHERE subscribed = 'Yes') AS subscribers,
           COUNT(*) FILTER (WHERE subscribed <> 'Yes') AS non_subscribers,
           {units("COUNT(*) FILTER (WHERE subscribed = 'Yes' AND is_churned)", "COUNT(*) FILTER (WHERE subscribed = 'Yes')", 10000)} AS su,
           {units("COUNT(*) FILTER (WHERE subscribed <> 'Yes' AND is_churned)", "COUNT(*) FILTER (WHERE subscribed <> 'Yes')", 10000)} AS nu
    FROM slong GROUP BY service_name
)"""

Q["db_service_lift"] = SLONG + _LIFT + f"""
SELECT service_name, subscribers, non_subscribers, {scaled('su', 2)} AS subscriber_churn_pct,
       {scaled('nu', 2)} AS non_subscriber_churn_pct, {scaled('nu - su', 2)} AS churn_lift_pct
FROM lift ORDER BY service_name"""

_ADOPT = f"""
, adopt AS (
    SELECT service_name, COUNT(*) FILTER (WHERE subscribed = 'Yes') AS adopters, COUNT(*) AS base,
           {pct("COUNT(*) FILTER (WHERE subscribed = 'Yes')", 'COUNT(*)')} AS adoption_pct
    FROM slong GROUP BY service_name
)"""

Q["db_adoption"] = SLONG + _ADOPT + "\nSELECT * FROM adopt ORDER BY service_name"

Q["db_price_by_tier_contract"] = f"""
SELECT internet_tier, contract_type, {N} AS customers, {avg_money(MRR, N)} AS avg_monthly_charges
FROM flat GROUP BY internet_tier, contract_type ORDER BY internet_tier, contract_type"""

Q["db_upsell_candidates"] = SLONG + _LIFT + _ADOPT + f"""
, j AS (SELECT a.service_name, a.adoption_pct, {scaled('nu - su', 2)} AS churn_lift_pct
        FROM adopt a JOIN lift l ON l.service_name = a.service_name WHERE a.adoption_pct < 50.0)
SELECT service_name, adoption_pct, churn_lift_pct,
       CAST(ROW_NUMBER() OVER (ORDER BY churn_lift_pct DESC, adoption_pct, service_name) AS BIGINT) AS upsell_rank
FROM j ORDER BY upsell_rank"""

_RET = f"""
, hr AS (
    SELECT customer_id, contract_type, internet_service, payment_method, tenure_months, monthly_charges,
           CAST(ROW_NUMBER() OVER (ORDER BY monthly_charges DESC, customer_id) AS BIGINT) AS charge_rank,
           COUNT(*) OVER () AS n
    FROM flat WHERE ({TIER}) = 'High Risk'
),
ret AS (SELECT *, CASE WHEN charge_rank <= (n * 1300 + 9999) // 10000 THEN 1 ELSE 2 END AS priority FROM hr)"""

Q["db_retention_list"] = _RET + """
SELECT customer_id, contract_type, internet_service, payment_method, tenure_months,
       CAST(monthly_charges AS DOUBLE) AS monthly_charges, charge_rank, priority
FROM ret ORDER BY charge_rank"""

Q["db_recoverable_mrr"] = _RET + f"""
SELECT COUNT(*) AS high_risk_customers, COUNT(*) FILTER (WHERE priority = 1) AS priority1_customers,
       {ratio('SUM(tenure_months)', 'COUNT(*)', 1)} AS avg_tenure_months,
       {money(f"SUM({cents('monthly_charges')})")} AS high_risk_mrr,
       {scaled(units(f"SUM({cents('monthly_charges')}) * 10000", '10000', 1), 2)} AS recoverable_mrr
FROM ret"""

# --- one dataset of each tab under filters
Q["db_overview_filtered"] = Q["db_overview_kpis"] + " WHERE senior_citizen = 'Yes'"
Q["db_revenue_filtered"] = Q["db_mrr_split"].replace("FROM long GROUP", "FROM long WHERE NOT (contract_length = 'Monthly') GROUP")
Q["db_risk_filtered"] = Q["db_crosstab"].replace(
    "FROM flat", f"FROM (SELECT * FROM flat WHERE ({TIER}) IN ('Churned', 'Medium Risk'))")
Q["db_services_filtered"] = SLONG.replace("FROM flat", "FROM flat WHERE internet_tier = 'Fiber Optic'") + _ADOPT + "\nSELECT * FROM adopt"
_MANY = ("gender = 'Female' AND contract_type IN ('Month-to-month', 'Two year') AND internet_service IN ('DSL', 'No') AND "
         "(tenure_months <= 12 OR tenure_months BETWEEN 25 AND 36 OR tenure_months > 60) AND payment_method NOT ILIKE '%automatic%'")
Q["db_cube_segments"] = Q["db_segment_table"].replace("FROM flat", f"FROM (SELECT * FROM flat WHERE {_MANY})")
Q["db_cube_charges"] = Q["db_charge_distribution"].replace(
    "FROM flat", f"FROM (SELECT * FROM flat WHERE senior_citizen = 'No' AND partner = 'Yes' AND ({TIER}) IN ('Low Risk', 'Medium Risk'))")
Q["db_retention_filtered"] = _RET.replace("= 'High Risk'", "= 'High Risk' AND internet_service = 'DSL'") + """
SELECT customer_id, contract_type, internet_service, payment_method, tenure_months,
       CAST(monthly_charges AS DOUBLE) AS monthly_charges, charge_rank, priority
FROM ret WHERE priority = 1"""


_BUCKETED = f"gender, senior_citizen, partner, dependents, tenure_bucket, contract_type, internet_service, payment_method, {TIER}"
Q["wh_reconcile"] = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, CAST({columns} AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS n_differences, COUNT(*) AS n_rows FROM {source}"
    for table, columns, source in [
        ("raw", 21, "raw"), ("quarantine", 22, "(SELECT * FROM raw WHERE customerid NOT IN (SELECT customer_id FROM stg))"),
        ("staging", 22, "stg"), ("dim_customer", 8, "dim_customer"), ("dim_contract", 6, "dim_contract"),
        ("dim_service_plan", 12, "dim_service_plan"), ("dim_tenure", 6, "dim_tenure"), ("fact_subscription", 14, "fact"),
        ("cube_cells", 57, f"(SELECT DISTINCT {_BUCKETED}, least(total_addons, 6) FROM flat)"),
        ("cube_charges", 12, f"(SELECT DISTINCT {_BUCKETED}, CAST(monthly_charges * 100 AS BIGINT) // 500 FROM flat)")])


def erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0 in plain SQL: Taylor series below 2.5, continued
    fraction above (absolute error ~1e-14 against libm)."""
    series = (
        f"(1 - 2 / sqrt(pi()) * list_reduce([({x}) ** (2 * k + 1) * (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)"
        f" / (exp(lgamma(k + 1)) * (2 * k + 1)) FOR k IN range(0, 80)], lambda a, b: a + b))"
    )
    frac = (
        f"(exp(-({x}) * ({x})) / sqrt(pi()) / list_reduce(list_reverse([j / 2.0 FOR j IN range(1, 120)]),"
        f" lambda acc, c: ({x}) + c / acc, {x}))"
    )
    return f"(CASE WHEN ({x}) < 2.5 THEN {series} ELSE {frac} END)"


def _mann_whitney(tag: str, value: str, divisor: int, variable: str) -> str:
    return f"""
x_{tag} AS (SELECT {value} AS v, churn = 'Yes' AS g FROM stg WHERE {value} IS NOT NULL),
pv_{tag} AS (SELECT v, COUNT(*) FILTER (WHERE g) AS n1v, COUNT(*) FILTER (WHERE NOT g) AS n2v FROM x_{tag} GROUP BY v),
r_{tag} AS (SELECT *, n1v + n2v AS t, SUM(n1v + n2v) OVER (ORDER BY v) - (n1v + n2v) AS before FROM pv_{tag}),
a_{tag} AS (
    SELECT SUM(CAST(n1v AS HUGEINT) * (2 * before + t + 1)) AS r1x2, SUM(CAST(t AS HUGEINT) * t * t - t) AS ties,
           CAST(SUM(n1v) AS BIGINT) AS n1, CAST(SUM(n2v) AS BIGINT) AS n2
    FROM r_{tag}
),
u_{tag} AS (
    SELECT *, r1x2 - CAST(n1 AS HUGEINT) * (n1 + 1) AS u1x2, CAST(n1 AS HUGEINT) + n2 AS n FROM a_{tag}
),
z_{tag} AS (
    SELECT *, round(CASE WHEN sigma > 0 THEN (big - mu - 0.5) / sigma END, 10) AS z
    FROM (SELECT *,
                 CAST(greatest(u1x2, CAST(n1 AS HUGEINT) * n2 * 2 - u1x2) AS DOUBLE) / 2.0 AS big,
                 CAST(CAST(n1 AS HUGEINT) * n2 AS DOUBLE) / 2.0 AS mu,
                 sqrt(CAST(CAST(n1 AS HUGEINT) * n2 AS DOUBLE) / 12.0
                      * (CAST(n + 1 AS DOUBLE) - CAST(ties AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE))) AS sigma
          FROM u_{tag})
),
{order_stats_cte(f'med_{tag}', f'x_{tag}', 'v', {'m': 0.5}, ['g'])},
out_{tag} AS (
    SELECT '{variable}' AS variable, n1 AS n_first, n2 AS n_second, CAST(u1x2 AS DOUBLE) / 2.0 AS u_statistic, z,
           (SELECT {q_value('m', divisor)} FROM med_{tag} WHERE g) AS median_first,
           (SELECT {q_value('m', divisor)} FROM med_{tag} WHERE NOT g) AS median_second,
           round(least(1.0, {erfc_sql('abs(z) / sqrt(2.0)')}), 10) AS p_value
    FROM z_{tag}
)"""


Q["st_mann_whitney"] = (
    ",\n" + _mann_whitney("m", "CAST(monthly_charges * 100 AS BIGINT)", 100, "monthly_charges") + ",\n"
    + _mann_whitney("t", "CAST(tenure_months AS BIGINT)", 1, "tenure_months")
    + "\nSELECT *, p_value < 0.05 AS significant FROM out_m UNION ALL SELECT *, p_value < 0.05 FROM out_t"
)


def oracles() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in Q.items()}
