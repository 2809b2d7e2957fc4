"""Oracle SQL for staging and the star tables."""

from __future__ import annotations

from .base import TEXT_COLUMNS, with_ctes

Q: dict[str, str] = {}

Q["stg_clean"] = """
SELECT customer_id, gender, senior_citizen, partner, dependents, tenure_months, contract_type,
       paperless_billing, payment_method, phone_service, multiple_lines, internet_service, online_security,
       online_backup, device_protection, tech_support, streaming_tv, streaming_movies,
       CAST(monthly_charges AS DOUBLE) AS monthly_charges, CAST(total_charges AS DOUBLE) AS total_charges, churn
FROM stg"""

Q["ing_raw_load"] = "SELECT * FROM raw"


def _quarantine_sql() -> str:
    """A NULL, unknown, oversized or repeated value of each column, in table order."""
    def text(raw: str, name: str, size: int) -> list[str]:
        return [f"CASE WHEN {raw} IS NULL THEN '{name}: missing' END",
                f"CASE WHEN length(trim({raw}, ' ')) > {size} THEN '{name}: longer than {size}' END"]

    def number(raw: str, name: str, kind: str, what: str) -> list[str]:
        return [f"CASE WHEN {raw} IS NULL THEN '{name}: missing' END",
                f"CASE WHEN {raw} IS NOT NULL AND TRY_CAST(trim({raw}, ' ') AS {kind}) IS NULL THEN '{name}: {what}' END"]

    money = ("DECIMAL(10,2)", "not numeric(10,2)")
    special = {
        "seniorcitizen": ["CASE WHEN seniorcitizen IS NULL THEN 'senior_citizen: missing' END",
                          "CASE WHEN trim(seniorcitizen, ' ') NOT IN ('0', '1') THEN 'senior_citizen: unknown code' END"],
        "tenure": number("tenure", "tenure_months", "INTEGER", "not integer"),
        "monthlycharges": number("monthlycharges", "monthly_charges", *money),
        "totalcharges": ["CASE WHEN trim(totalcharges, ' ') <> '' AND TRY_CAST(trim(totalcharges, ' ') AS DECIMAL(10,2)) IS NULL "
                         "THEN 'total_charges: not numeric(10,2)' END"],
    }
    order = ["customerid", "gender", "seniorcitizen", "partner", "dependents", "tenure", "contract", "paperlessbilling",
             "paymentmethod", "phoneservice", "multiplelines", "internetservice", "onlinesecurity", "onlinebackup",
             "deviceprotection", "techsupport", "streamingtv", "streamingmovies", "monthlycharges", "totalcharges", "churn"]
    reasons = [r for c in order for r in (special.get(c) or text(c, *TEXT_COLUMNS[c]))]
    reasons.append("CASE WHEN n > 1 THEN 'customer_id: duplicated ' || n || ' times' END")
    return f"""
, counted AS (SELECT *, count(*) OVER (PARTITION BY trim(customerid, ' ')) AS n FROM raw)
SELECT * EXCLUDE (n) FROM (SELECT *, concat_ws('; ', {', '.join(reasons)}) AS reason FROM counted) WHERE reason <> ''"""


Q["stg_quarantine"] = _quarantine_sql()

Q["dim_customer"] = "SELECT * FROM dim_customer"
Q["dim_contract"] = "SELECT * FROM dim_contract"
Q["dim_service_plan"] = "SELECT * FROM dim_service_plan"
Q["fact_subscription"] = """
SELECT subscription_key, customer_key, contract_key, service_key, date_key, customer_id, tenure_months,
       CAST(monthly_charges AS DOUBLE) AS monthly_charges, CAST(total_charges AS DOUBLE) AS total_charges,
       CAST(estimated_clv AS DOUBLE) AS estimated_clv, CAST(mrr_at_risk AS DOUBLE) AS mrr_at_risk,
       churn, is_churned
FROM fact"""


def oracles() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in Q.items()}
