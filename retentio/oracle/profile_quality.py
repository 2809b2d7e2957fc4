"""Oracle SQL for profiling (raw) and quality checks (raw, staging, star)."""

from __future__ import annotations

from .base import SERVICE_NATURAL, TEXT_COLUMNS, avg_money, cents, money, pct, ratio, scaled, units, with_ctes
from .sqlgen import order_stats_cte, q_scaled, row

Q: dict[str, str] = {}

# --- fixed values: the raw table's columns
RAW_COLUMNS = [
    "customerid", "gender", "seniorcitizen", "partner", "dependents", "tenure", "phoneservice", "multiplelines",
    "internetservice", "onlinesecurity", "onlinebackup", "deviceprotection", "techsupport", "streamingtv",
    "streamingmovies", "contract", "paperlessbilling", "paymentmethod", "monthlycharges", "totalcharges", "churn",
]

Q["prof_shape"] = f"SELECT COUNT(*) AS n_rows, CAST({len(RAW_COLUMNS)} AS BIGINT) AS n_columns FROM raw"
Q["prof_sample"] = "SELECT * FROM raw ORDER BY customerid LIMIT 5"

_null_counts = ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in RAW_COLUMNS)
Q["prof_missing"] = (
    f", c AS (SELECT COUNT(*) AS _n, {_null_counts} FROM raw)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {c} AS missing_count, {pct(c, '_n')} AS missing_pct FROM c WHERE {c} > 0"
        for c in RAW_COLUMNS
    )
)

_BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_blank = ", ".join(f"COUNT(*) FILTER (WHERE trim({c}, {_BLANK_CHARS}) = '') AS {c}" for c in RAW_COLUMNS)
Q["prof_blank"] = (
    f", c AS (SELECT {_blank} FROM raw)\n"
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, {c} AS blank_count FROM c WHERE {c} > 0" for c in RAW_COLUMNS)
    + "\nUNION ALL\nSELECT '*' AS column_name, CAST(" + " + ".join(RAW_COLUMNS) + " AS BIGINT) AS blank_count FROM c"
)

Q["prof_duplicates"] = """
SELECT n - d AS duplicate_rows, n - k AS duplicate_keys
FROM (SELECT COUNT(*) AS n FROM raw), (SELECT COUNT(*) AS d FROM (SELECT DISTINCT * FROM raw)),
     (SELECT COUNT(*) AS k FROM (SELECT DISTINCT customerid FROM raw))"""

Q["prof_categories"] = f"""
, l AS (SELECT * FROM raw UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(RAW_COLUMNS)})))
SELECT column_name, value, COUNT(*) AS value_count FROM l GROUP BY column_name, value ORDER BY column_name, value"""

# Columns every value of which parses as a number, for the derived raw table.
_NUMERIC_RAW = ["customerid", "seniorcitizen", "tenure", "monthlycharges"]


def describe_sql(source: str, columns: list[str], scale: int = 2) -> str:
    unit = 10**scale
    longs = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(CAST({c} AS DECIMAL(30,{scale})) * {unit} AS HUGEINT) AS v FROM {source}"
        for c in columns
    )
    return f"""
, long AS ({longs}),
{order_stats_cte('qs', 'long', 'v', {'p25': 0.25, 'p50': 0.5, 'p75': 0.75}, ['column_name'])},
mo AS (SELECT column_name, COUNT(*) AS _n, SUM(v) AS _s, SUM(v * v) AS _ss, MIN(v) AS _min, MAX(v) AS _max
       FROM long WHERE v IS NOT NULL GROUP BY column_name)
SELECT mo.column_name, _n AS count, {scaled(units('_s', '_n', 1), scale)} AS mean,
       round(sqrt(CAST(_n * _ss - _s * _s AS DOUBLE) / CAST(_n * (_n - 1) AS DOUBLE)) / {float(unit)}, {scale}) AS std,
       {scaled('_min', scale)} AS min, {q_scaled('p25', scale)} AS p25, {q_scaled('p50', scale)} AS p50,
       {q_scaled('p75', scale)} AS p75, {scaled('_max', scale)} AS max
FROM mo JOIN qs ON qs.column_name = mo.column_name ORDER BY mo.column_name"""


Q["prof_numeric"] = describe_sql("raw", _NUMERIC_RAW)

# a value's type by patterns, a column's by its values' types
Q["prof_types"] = f"""
, l AS (SELECT column_name, value, trim(value, {_BLANK_CHARS}) AS t FROM raw
        UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(RAW_COLUMNS)}))),
k AS (
    SELECT *, regexp_full_match(t, '[+-]?([0-9]+)') AS is_int, regexp_full_match(t, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)') AS is_dec,
           regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)[eE][+-]?[0-9]+|[+-]?([iI]nf|[iI]nfinity)') AS is_exp,
           t IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false') AS is_bool
    FROM l),
d AS (
    SELECT column_name, COUNT(*) AS n_values, COUNT(*) FILTER (WHERE value IS NULL) AS missing_count, coalesce(MAX(length(value)), 0) AS width,
           coalesce(MAX(length(regexp_extract(t, '^[+-]?0*([0-9]*)', 1))) FILTER (WHERE is_int OR is_dec), 0) AS before,
           coalesce(MAX(length(regexp_extract(t, '[.]([0-9]*)$', 1))) FILTER (WHERE is_dec), 0) AS behind,
           COUNT(value) AS n, COUNT(*) FILTER (WHERE is_int) AS ints, COUNT(*) FILTER (WHERE is_dec) AS decs,
           COUNT(*) FILTER (WHERE is_exp) AS exps, COUNT(*) FILTER (WHERE is_bool) AS bools
    FROM k GROUP BY column_name)
SELECT column_name,
       CASE WHEN n = 0 THEN 'missing' WHEN bools = n THEN 'boolean' WHEN ints = n AND before <= 9 THEN 'int'
            WHEN ints = n AND before <= 18 THEN 'bigint'
            WHEN ints + decs = n AND before + behind <= 38 THEN 'decimal(' || greatest(before + behind, 1) || ',' || behind || ')'
            WHEN ints + decs + exps = n THEN 'double' ELSE 'text' END AS inferred_type,
       CAST(width AS BIGINT) AS width, missing_count, n_values, CAST(before + behind AS BIGINT) AS digits, CAST(behind AS BIGINT) AS scale
FROM d"""

Q["prof_coerce"] = """
SELECT customerid, tenure, monthlycharges, totalcharges FROM raw
WHERE TRY_CAST(totalcharges AS DOUBLE) IS NULL ORDER BY customerid"""

Q["prof_target"] = f"""
SELECT churn, COUNT(*) AS customer_count, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total
FROM raw GROUP BY churn ORDER BY churn"""

# --- quality -------------------------------------------------------------------

Q["dq_row_counts"] = (
    ", c AS (SELECT (SELECT COUNT(*) FROM raw) AS raw, (SELECT COUNT(*) FROM stg) AS staging, "
    "(SELECT COUNT(*) FROM fact) AS fact, (SELECT COUNT(*) FROM dim_customer) AS dim_customer, "
    "(SELECT COUNT(*) FROM dim_contract) AS dim_contract, (SELECT COUNT(*) FROM dim_service_plan) AS dim_service_plan, "
    "(SELECT COUNT(*) FROM dim_tenure) AS dim_tenure)\n"
    + "\nUNION ALL\n".join(
        [row("row_count", "staging_vs_raw", "staging", "raw") + " FROM c",
         row("row_count", "fact_vs_staging", "fact", "staging") + " FROM c"]
        + [row("table_rows", t, t) + " FROM c" for t in ["dim_contract", "dim_customer", "dim_service_plan", "dim_tenure"]]
        + [row("table_rows", "fact_subscription", "fact") + " FROM c"]
    )
)

_STG_NULL = ["customer_id", "gender", "senior_citizen", "tenure_months", "contract_type", "monthly_charges",
             "total_charges", "churn"]
_RAW_NULL = ["customerid", "tenure", "monthlycharges", "totalcharges", "churn"]
Q["dq_nulls"] = (
    ", s AS (SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _STG_NULL) + " FROM stg),\n"
    "r AS (SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _RAW_NULL) + " FROM raw)\n"
    + "\nUNION ALL\n".join(
        [row("null_count", f"staging.{c}", c, None if c == "total_charges" else "0") + " FROM s" for c in _STG_NULL]
        + [row("null_count", f"raw.{c}", c) + " FROM r" for c in _RAW_NULL]
    )
)

Q["dq_recode"] = """
SELECT 'raw.seniorcitizen' AS layer, seniorcitizen AS value, COUNT(*) AS customer_count, CAST(NULL AS BOOLEAN) AS allowed
FROM raw GROUP BY seniorcitizen
UNION ALL
SELECT 'staging.senior_citizen', senior_citizen, COUNT(*), senior_citizen IN ('Yes', 'No')
FROM stg GROUP BY senior_citizen
ORDER BY layer, value"""

Q["dq_blank_to_null"] = (
    ", c AS (SELECT (SELECT COUNT(*) FROM raw WHERE trim(totalcharges, ' ') = '' OR totalcharges IS NULL) AS b, "
    "(SELECT COUNT(*) FROM stg WHERE total_charges IS NULL) AS z)\n"
    + row("blank_to_null", "total_charges", "z", "b") + " FROM c"
)

Q["dq_null_detail"] = """
SELECT customer_id, tenure_months, CAST(monthly_charges AS DOUBLE) AS monthly_charges,
       CAST(total_charges AS DOUBLE) AS total_charges, tenure_months = 0 AS tenure_is_zero
FROM stg WHERE total_charges IS NULL ORDER BY customer_id"""

Q["dq_range"] = f"""
SELECT MIN(tenure_months) AS min_tenure, MAX(tenure_months) AS max_tenure,
       {ratio('SUM(tenure_months)', 'COUNT(*)', 1)} AS avg_tenure,
       CAST(MIN(monthly_charges) AS DOUBLE) AS min_monthly, CAST(MAX(monthly_charges) AS DOUBLE) AS max_monthly,
       {avg_money(f"SUM({cents('monthly_charges')})", 'COUNT(*)')} AS avg_monthly,
       CAST(MIN(total_charges) AS DOUBLE) AS min_total, CAST(MAX(total_charges) AS DOUBLE) AS max_total
FROM stg"""

_YN = ["senior_citizen", "partner", "dependents", "phone_service", "paperless_billing", "churn"]
Q["dq_domain"] = (
    ", a AS (SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} NOT IN ('Yes', 'No')) AS {c}" for c in _YN) + " FROM stg)\n"
    + "\nUNION ALL\n".join(row("yes_no_domain", c, c, "0") + " FROM a" for c in _YN)
)

_WS = ["customer_id", "gender", "contract_type", "payment_method"]
Q["dq_whitespace"] = (
    ", a AS (SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} != trim({c}, ' ')) AS {c}" for c in _WS) + " FROM stg)\n"
    + "\nUNION ALL\n".join(row("whitespace", c, c, "0") + " FROM a" for c in _WS)
)

Q["dq_contract_mix"] = f"""
SELECT contract_type, COUNT(*) AS customer_count,
       {avg_money(f"SUM({cents('monthly_charges')})", 'COUNT(*)')} AS avg_monthly_charges,
       {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total
FROM stg GROUP BY contract_type ORDER BY contract_type"""

Q["dq_payment_mix"] = "SELECT payment_method, COUNT(*) AS customer_count FROM stg GROUP BY payment_method ORDER BY customer_count DESC"

Q["dq_flag_consistency"] = "SELECT churn, is_churned, COUNT(*) AS count FROM fact GROUP BY churn, is_churned ORDER BY churn"

Q["dq_mrr_total"] = f"""
SELECT {money(f"SUM({cents('mrr_at_risk')})")} AS total_mrr_at_risk,
       COUNT(*) FILTER (WHERE is_churned) AS churned_customers FROM fact"""

Q["dq_contract_revenue"] = f"""
SELECT dc.contract_type, COUNT(*) AS customers, {money(f"SUM({cents('f.monthly_charges')})")} AS total_mrr,
       {avg_money(f"SUM({cents('f.monthly_charges')})", 'COUNT(*)')} AS avg_monthly,
       CAST(SUM(CASE WHEN f.is_churned THEN 1 ELSE 0 END) AS BIGINT) AS churned
FROM fact f JOIN dim_contract dc ON dc.contract_key = f.contract_key
GROUP BY dc.contract_type ORDER BY total_mrr DESC"""

Q["dq_orphans"] = (
    ", c AS (SELECT "
    "COUNT(*) FILTER (WHERE customer_key NOT IN (SELECT customer_key FROM dim_customer)) AS orphan_customer, "
    "COUNT(*) FILTER (WHERE contract_key NOT IN (SELECT contract_key FROM dim_contract)) AS orphan_contract, "
    "COUNT(*) FILTER (WHERE service_key NOT IN (SELECT service_key FROM dim_service_plan)) AS orphan_service, "
    "COUNT(*) FILTER (WHERE date_key NOT IN (SELECT date_key FROM dim_tenure)) AS orphan_date FROM fact)\n"
    + "\nUNION ALL\n".join(
        row("orphans", n, n, "0") + " FROM c"
        for n in ["orphan_customer", "orphan_contract", "orphan_service", "orphan_date"]
    )
)

# --- fixed values: what the tables declare
_NOT_NULL = ["customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months", "contract_type",
             "paperless_billing", "payment_method", "monthly_charges", "churn"]
_SETS = {c: "'Yes', 'No'" for c in ["churn", "partner", "dependents", "senior_citizen", "paperless_billing"]} | {
    "gender": "'Male', 'Female'", "contract_type": "'Month-to-month', 'One year', 'Two year'"}
_NATURAL = {"dim_customer": ["customer_id"], "dim_contract": ["contract_type", "payment_method", "paperless_billing"],
            "dim_service_plan": list(SERVICE_NATURAL), "dim_tenure": ["tenure_months"]}
_SURROGATE = {"dim_customer": "customer_key", "dim_contract": "contract_key", "dim_service_plan": "service_key", "dim_tenure": "date_key"}


def _constraints() -> str:
    """One SELECT a constraint, over the tables as they are and ``cand``, staging with every raw row."""
    parts = []

    def add(table: str, kind: str, columns: list[str], count: str, parent: str = "") -> None:
        name = f"{kind}: {', '.join(columns)}" + (f" -> {parent}" if parent else "")
        parts.append(f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, '{kind}' AS kind, CAST(({count}) AS BIGINT) AS violations")

    def source(table: str) -> str:
        return {"staging": "cand", "fact_subscription": "fact"}.get(table, table)

    def rows(table: str, where: str) -> str:
        return f"SELECT COUNT(*) FROM {source(table)} WHERE {where}"

    def unique(table: str, columns: list[str]) -> None:
        known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        add(table, "unique", columns, f"SELECT COUNT(*) - COUNT(DISTINCT ({', '.join(columns)})) FROM {source(table)} WHERE {known}")

    def reference(table: str, column: str, parent: str) -> None:
        add(table, "reference", [column],
            rows(table, f"{column} IS NOT NULL AND {column} NOT IN (SELECT {column} FROM {source(parent)} WHERE {column} IS NOT NULL)"), parent)

    add("raw", "domain", ["seniorcitizen"], rows("raw", "seniorcitizen NOT IN ('0', '1')"))
    add("raw", "trimmed", ["totalcharges"], rows("raw", "totalcharges <> trim(totalcharges, ' ')"))
    unique("staging", ["customer_id"])
    reference("staging", "customer_id", "dim_customer")
    for c in _NOT_NULL:
        add("staging", "not null", [c], rows("staging", f"{c} IS NULL"))
    for c, values in _SETS.items():
        add("staging", "domain", [c], rows("staging", f"{c} NOT IN ({values})"))
    for c in ["customer_id", "contract_type", "payment_method", "internet_service"]:
        add("staging", "trimmed", [c], rows("staging", f"{c} <> trim({c}, ' ')"))
    add("staging", "range", ["tenure_months"], rows("staging", "NOT tenure_months BETWEEN 0 AND 72"))
    add("staging", "range", ["monthly_charges"], rows("staging", "monthly_charges < 0"))
    for table, key in _SURROGATE.items():
        unique(table, [key])
        unique(table, _NATURAL[table])
        add(table, "not null", [key], rows(table, f"{key} IS NULL"))
        reference("fact_subscription", key, table)
        add("fact_subscription", "not null", [key], rows("fact_subscription", f"{key} IS NULL"))
    unique("fact_subscription", ["subscription_key"])
    unique("fact_subscription", ["customer_id"])
    reference("fact_subscription", "customer_id", "staging")
    texts = ", ".join(f"trim({raw}, ' ') AS {name}" for raw, (name, _) in TEXT_COLUMNS.items())
    return f""",
cand AS (
    SELECT {texts}, CASE trim(seniorcitizen, ' ') WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' END AS senior_citizen,
           TRY_CAST(trim(tenure, ' ') AS INTEGER) AS tenure_months, TRY_CAST(trim(monthlycharges, ' ') AS DECIMAL(10,2)) AS monthly_charges
    FROM raw)
""" + "\nUNION ALL\n".join(parts)


Q["dq_constraints"] = _constraints()

Q["dq_dim_listing"] = """
SELECT 'dim_contract' AS dimension, contract_key AS key,
       concat_ws(' | ', contract_type, payment_method, paperless_billing, payment_category, contract_length) AS attributes
FROM dim_contract
UNION ALL
SELECT 'dim_service_plan', service_key,
       concat_ws(' | ', phone_service, multiple_lines, internet_service, online_security, online_backup, device_protection,
                 tech_support, streaming_tv, streaming_movies, CAST(total_addons AS VARCHAR), internet_tier)
FROM dim_service_plan"""

Q["dq_dim_profile"] = """
SELECT 'dim_customer' AS dimension, 'rows' AS attribute, CAST(NULL AS VARCHAR) AS value, COUNT(*) AS count FROM dim_customer
UNION ALL SELECT 'dim_contract', 'rows', NULL, COUNT(*) FROM dim_contract
UNION ALL SELECT 'dim_service_plan', 'rows', NULL, COUNT(*) FROM dim_service_plan
UNION ALL SELECT 'dim_tenure', 'rows', NULL, COUNT(*) FROM dim_tenure
UNION ALL SELECT 'dim_service_plan', 'internet_tier', internet_tier, COUNT(*) FROM dim_service_plan GROUP BY internet_tier
UNION ALL SELECT 'dim_contract', 'payment_category', payment_category, COUNT(*) FROM dim_contract GROUP BY payment_category
ORDER BY dimension, attribute, value"""


def oracles() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in Q.items()}
