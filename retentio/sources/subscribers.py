"""Raw subscriber records derived from the order/customer/lineitem tables.

One ``orders`` row is one subscription.  Every raw column is a string, as a
CSV landing table would be.  The derivation rules are fixture parameters
(see FIXTURES.md §2), not business rules.

Every line item counts, and months beyond the tenure dimension wrap around, so
no row is cut or clamped.  A thin slice of the records is dirty on purpose
(copied ids, unknown codes, missing and oversized values): what staging must
refuse.

Plan shape: ``lineitem`` is pruned to two columns and pre-aggregated map-side
to one row per order before it shuffles; it then meets ``orders`` on the order
key, and the result meets ``customer`` on the customer key.  No side is broadcast blindly: one row per
order is never broadcast, the customers are where their measured size is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_or_merge, never_broadcast

RAW_COLUMNS = [
    "customerid", "gender", "seniorcitizen", "partner", "dependents", "tenure",
    "phoneservice", "multiplelines", "internetservice", "onlinesecurity",
    "onlinebackup", "deviceprotection", "techsupport", "streamingtv",
    "streamingmovies", "contract", "paperlessbilling", "paymentmethod",
    "monthlycharges", "totalcharges", "churn",
]


#: months of the tenure dimension, 0 included
MONTHS = 73
#: bytes of a customer table that every task of the raw derivation may hold
MAX_CUSTOMER_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def _dirty(k: Column, modulus: int, rest: int) -> Column:
    return F.pmod(k, F.lit(modulus)) == rest


def _addon(internet_none: Column, k: Column, modulus: int, below: int) -> Column:
    return (
        F.when(internet_none, F.lit("No internet service"))
        .when(F.pmod(k, F.lit(modulus)) < below, F.lit("Yes"))
        .otherwise(F.lit("No"))
    )


def derive_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the 21-string-column raw table for the tables under ``sf_dir``."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    returns = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg((2 * F.count_if(F.col("l_returnflag") == "R") >= F.count(F.lit(1))).alias("returned"))
    )

    src = (
        orders.join(never_broadcast(returns), orders.o_orderkey == returns.l_orderkey, "left")
        .join(broadcast_or_merge(customer, max_bytes=MAX_CUSTOMER_BYTES), orders.o_custkey == customer.c_custkey, "inner")
    )

    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    tenure = F.pmod((F.lit(2001) - F.year("o_orderdate")) * 12 + 8 - F.month("o_orderdate"), F.lit(MONTHS))
    price = F.col("o_totalprice").cast("decimal(12,2)")
    monthly = (F.lit(18.25).cast("decimal(12,2)") + price % F.lit(100.50).cast("decimal(12,2)")).cast(
        "decimal(12,2)"
    )
    segment = F.col("c_mktsegment")
    no_internet = segment == "BUILDING"
    no_phone = F.pmod(k, F.lit(10)) == 0

    return src.select(
        F.lpad((k - _dirty(k, 499, 1).cast("int")).cast("string"), 10, "0").alias("customerid"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when(_dirty(k, 211, 3), F.lit("2")).when(F.pmod(c, F.lit(6)) == 0, F.lit("1")).otherwise(F.lit("0"))
        .alias("seniorcitizen"),
        F.when(~_dirty(k, 307, 5), _yes_no(F.pmod(c, F.lit(2)) == 0)).alias("partner"),
        _yes_no(F.pmod(F.col("c_nationkey"), F.lit(3)) == 0).alias("dependents"),
        tenure.cast("string").alias("tenure"),
        _yes_no(~no_phone).alias("phoneservice"),
        F.when(no_phone, F.lit("No phone service"))
        .when(F.pmod(k, F.lit(3)) == 0, F.lit("Yes"))
        .otherwise(F.lit("No"))
        .alias("multiplelines"),
        F.when(no_internet, F.lit("No"))
        .when(segment.isin("MACHINERY", "HOUSEHOLD"), F.lit("DSL"))
        .otherwise(F.lit("Fiber optic"))
        .alias("internetservice"),
        _addon(no_internet, k, 4, 1).alias("onlinesecurity"),
        _addon(no_internet, k, 5, 2).alias("onlinebackup"),
        _addon(no_internet, k, 7, 3).alias("deviceprotection"),
        _addon(no_internet, k, 11, 4).alias("techsupport"),
        _addon(no_internet, k, 13, 6).alias("streamingtv"),
        _addon(no_internet, k, 17, 8).alias("streamingmovies"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Month-to-month"))
        .when(F.col("o_orderstatus") == "F", F.lit("One year"))
        .when(F.col("o_orderstatus") == "O", F.lit("Two year"))
        .alias("contract"),
        _yes_no(F.pmod(c, F.lit(5)) < 3).alias("paperlessbilling"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Electronic check"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Mailed check"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Bank transfer (automatic)"))
        .otherwise(F.lit("Credit card (automatic)"))
        .alias("paymentmethod"),
        F.when(_dirty(k, 401, 7), F.lit("12345678901.00")).otherwise(monthly.cast("string")).alias("monthlycharges"),
        F.when(tenure == 0, F.lit(" ")).otherwise((monthly * tenure).cast("string")).alias("totalcharges"),
        _yes_no(F.coalesce("returned", F.lit(False))).alias("churn"),
    )
