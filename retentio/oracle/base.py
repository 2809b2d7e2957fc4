"""DuckDB oracle: the raw → staging → star derivation as SQL CTEs.

DuckDB only sees the base parquet tables, so every oracle query starts with
``WITH`` + these CTEs and appends its own.  ``flat`` is one wide view with a
row per accepted subscription: labels come from small lookup tables, keys from
``dense_rank`` over the natural columns, and the star tables are projections
of it.  Nothing here is imported from the engine.

The helpers mirror ``retentio.functions.rounding``: money as integer cents,
ratios rounded half-up with integer division, results as DOUBLE.
"""

from __future__ import annotations


def units(num: str, den: str, mult: int = 1) -> str:
    """round_half_up(num * mult / den) for num >= 0, den > 0; NULL when den <= 0."""
    return (
        f"(CASE WHEN ({den}) > 0 THEN (2 * CAST({num} AS HUGEINT) * {mult} + ({den})) "
        f"// (2 * CAST({den} AS HUGEINT)) END)"
    )


def scaled(units_sql: str, scale: int) -> str:
    return f"(CAST({units_sql} AS DOUBLE) / CAST({10**scale} AS DOUBLE))"


def ratio(num: str, den: str, scale: int, mult: int = 1) -> str:
    return scaled(units(num, den, mult * 10**scale), scale)


def pct(part: str, whole: str, scale: int = 2) -> str:
    return ratio(part, whole, scale, 100)


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS BIGINT)"


def money(c: str) -> str:
    return scaled(c, 2)


def avg_money(sum_c: str, n: str) -> str:
    return scaled(units(sum_c, n, 1), 2)


RAW_CTE = """
flags AS (
    SELECT l_orderkey AS k, 2 * count(*) FILTER (WHERE l_returnflag = 'R') >= count(*) AS returned
    FROM lineitem GROUP BY ALL
),
src AS (
    SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS nk, c_mktsegment AS seg, o_orderstatus AS st,
           o_orderpriority AS pr, coalesce(returned, false) AS returned,
           (((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate)) % 73 + 73) % 73 AS t,
           CAST(CAST(18.25 AS DECIMAL(12,2)) + CAST(o_totalprice AS DECIMAL(12,2)) % CAST(100.50 AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS m
    FROM (SELECT *, o_orderkey AS k FROM orders) LEFT JOIN flags USING (k) JOIN customer ON c_custkey = o_custkey
),
raw AS (
    SELECT
        lpad(CAST(CASE WHEN k % 499 = 1 THEN k - 1 ELSE k END AS VARCHAR), 10, '0') AS customerid,
        CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
        CASE WHEN k % 211 = 3 THEN '2' WHEN c % 6 = 0 THEN '1' ELSE '0' END AS seniorcitizen,
        CASE WHEN k % 307 = 5 THEN NULL WHEN c % 2 = 0 THEN 'Yes' ELSE 'No' END AS partner,
        CASE WHEN nk % 3 = 0 THEN 'Yes' ELSE 'No' END AS dependents,
        CAST(t AS VARCHAR) AS tenure,
        CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS phoneservice,
        CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS multiplelines,
        CASE WHEN seg = 'BUILDING' THEN 'No' WHEN seg IN ('MACHINERY', 'HOUSEHOLD') THEN 'DSL' ELSE 'Fiber optic' END AS internetservice,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 4 < 1 THEN 'Yes' ELSE 'No' END AS onlinesecurity,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 5 < 2 THEN 'Yes' ELSE 'No' END AS onlinebackup,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS deviceprotection,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 11 < 4 THEN 'Yes' ELSE 'No' END AS techsupport,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 13 < 6 THEN 'Yes' ELSE 'No' END AS streamingtv,
        CASE WHEN seg = 'BUILDING' THEN 'No internet service' WHEN k % 17 < 8 THEN 'Yes' ELSE 'No' END AS streamingmovies,
        CASE st WHEN 'P' THEN 'Month-to-month' WHEN 'F' THEN 'One year' WHEN 'O' THEN 'Two year' END AS contract,
        CASE WHEN c % 5 < 3 THEN 'Yes' ELSE 'No' END AS paperlessbilling,
        CASE pr WHEN '1-URGENT' THEN 'Electronic check' WHEN '2-HIGH' THEN 'Mailed check'
                WHEN '3-MEDIUM' THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS paymentmethod,
        CASE WHEN k % 401 = 7 THEN '12345678901.00' ELSE CAST(m AS VARCHAR) END AS monthlycharges,
        CASE WHEN t = 0 THEN ' ' ELSE CAST(m * t AS VARCHAR) END AS totalcharges,
        CASE WHEN returned THEN 'Yes' ELSE 'No' END AS churn
    FROM src
)"""

#: fixed values: staging text columns by raw name, with their declared lengths
TEXT_COLUMNS = {
    "customerid": ("customer_id", 20), "gender": ("gender", 10), "partner": ("partner", 3), "dependents": ("dependents", 3),
    "contract": ("contract_type", 30), "paperlessbilling": ("paperless_billing", 3), "paymentmethod": ("payment_method", 50),
    "phoneservice": ("phone_service", 3), "multiplelines": ("multiple_lines", 20), "internetservice": ("internet_service", 20),
    "onlinesecurity": ("online_security", 20), "onlinebackup": ("online_backup", 20),
    "deviceprotection": ("device_protection", 20), "techsupport": ("tech_support", 20), "streamingtv": ("streaming_tv", 20),
    "streamingmovies": ("streaming_movies", 20), "churn": ("churn", 3),
}
SERVICE_NATURAL = ("phone_service", "multiple_lines", "internet_service", "online_security", "online_backup",
                   "device_protection", "tech_support", "streaming_tv", "streaming_movies")
ADDONS = ("multiple_lines", "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
          "streaming_movies")
BUCKETS = ("0-12 months", "13-24 months", "25-36 months", "37-48 months", "49-60 months", "61+ months")


def _values(name: str, columns: str, rows: list[tuple[str, ...]]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + ")"


_fits = " AND ".join(f"length(trim({raw}, ' ')) <= {n}" for raw, (_, n) in TEXT_COLUMNS.items())
_texts = ", ".join(f"trim({raw}, ' ') AS {name}" for raw, (name, _) in TEXT_COLUMNS.items())
_plan = ", ".join(SERVICE_NATURAL)
_deal = "contract_type, payment_method, paperless_billing"

#: a NULL in any condition refuses the row, which is what NOT NULL asks for
STG_CTE = f"""
accepted AS (
    SELECT * FROM raw
    QUALIFY count(*) OVER (PARTITION BY trim(customerid, ' ')) = 1 AND trim(seniorcitizen, ' ') IN ('0', '1')
        AND TRY_CAST(trim(tenure, ' ') AS INTEGER) IS NOT NULL
        AND TRY_CAST(trim(monthlycharges, ' ') AS DECIMAL(10,2)) IS NOT NULL
        AND (coalesce(trim(totalcharges, ' '), '') = '' OR TRY_CAST(trim(totalcharges, ' ') AS DECIMAL(10,2)) IS NOT NULL)
        AND {_fits}
),
stg AS (
    SELECT {_texts},
           ['No', 'Yes'][1 + CAST(trim(seniorcitizen, ' ') AS INTEGER)] AS senior_citizen,
           CAST(trim(tenure, ' ') AS INTEGER) AS tenure_months,
           CAST(trim(monthlycharges, ' ') AS DECIMAL(10,2)) AS monthly_charges,
           CAST(nullif(trim(totalcharges, ' '), '') AS DECIMAL(10,2)) AS total_charges
    FROM accepted
)"""

STAR_CTE = ",\n".join([
    "\n" + _values("households", "partner, dependents, household_type", [
        ("Yes", "Yes", "Family"), ("Yes", "No", "Couple No Dependents"),
        ("No", "Yes", "Single With Dependents"), ("No", "No", "Single No Dependents")]),
    _values("terms", "contract_type, contract_length", [
        ("Month-to-month", "Monthly"), ("One year", "Annual"), ("Two year", "Two-Year")]),
    _values("tiers", "internet_service, internet_tier", [("Fiber optic", "Fiber Optic"), ("DSL", "DSL"), ("No", "No Internet")]),
    f"""keyed AS (
    SELECT *, row_number() OVER (ORDER BY customer_id) AS customer_key,
           dense_rank() OVER (ORDER BY {_deal}) AS contract_key, dense_rank() OVER (ORDER BY {_plan}) AS service_key,
           coalesce(household_type, 'Unknown') AS household, coalesce(contract_length, 'Unknown') AS term,
           coalesce(internet_tier, 'Unknown') AS tier,
           if(senior_citizen = 'Yes', 'Senior', 'Non-Senior') AS senior_segment,
           if(contains(lower(payment_method), 'automatic'), 'Automatic', 'Manual') AS payment_category,
           CAST(list_sum(list_transform([{', '.join(ADDONS)}], lambda x: CAST(x = 'Yes' AS INTEGER))) AS INTEGER) AS total_addons
    FROM stg LEFT JOIN households USING (partner, dependents) LEFT JOIN terms USING (contract_type)
         LEFT JOIN tiers USING (internet_service)
),
wide AS (
    SELECT * EXCLUDE (household_type, contract_length, internet_tier, household, term, tier),
           household AS household_type, term AS contract_length, tier AS internet_tier
    FROM keyed
),
dim_tenure AS (
    SELECT CAST(g AS INTEGER) AS date_key, CAST(g AS INTEGER) AS tenure_months,
           {list(BUCKETS)}[least(6, 1 + (greatest(g, 1) - 1) // 12)] AS tenure_bucket,
           CAST(1 + (greatest(g, 1) - 1) // 12 AS INTEGER) AS tenure_year, g <= 12 AS is_new_customer, g >= 48 AS is_long_term
    FROM range(73) AS months(g)
),
flat AS (
    SELECT *, customer_key AS subscription_key, churn = 'Yes' AS is_churned,
           if(churn = 'Yes', monthly_charges, NULL) AS mrr_at_risk,
           CAST(if(total_charges IS NULL, NULL, monthly_charges * tenure_months) AS DECIMAL(12,2)) AS estimated_clv
    FROM wide JOIN dim_tenure USING (tenure_months)
),
fact AS (
    SELECT subscription_key, customer_key, contract_key, service_key, date_key, customer_id, tenure_months, monthly_charges,
           total_charges, estimated_clv, mrr_at_risk, churn, is_churned
    FROM flat
),
dim_customer AS (
    SELECT customer_key, customer_id, gender, senior_citizen, partner, dependents, household_type, senior_segment FROM wide
),
dim_contract AS (SELECT DISTINCT contract_key, {_deal}, payment_category, contract_length FROM wide),
dim_service_plan AS (SELECT DISTINCT service_key, {_plan}, total_addons, internet_tier FROM wide)"""])


def with_ctes(body: str, star: bool = True, staging: bool = True) -> str:
    """Prefix ``body`` (a SELECT, optionally starting with more CTEs as
    ``name AS (...)`` after a leading comma) with the derivation CTEs."""
    parts = [RAW_CTE]
    if staging or star:
        parts.append(STG_CTE)
    if star:
        parts.append(STAR_CTE)
    head = "WITH" + ",".join(parts)
    body = body.strip()
    if body.startswith(","):
        return f"{head}{body}"
    return f"{head}\n{body}"
