"""The five domain tables as views over a star schema of orders and events.

Line items play transactions (an order's line is the source event; it occurs several times), customers play accounts,
orders by month and customer play snapshots, and documents play complaints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import money, month_of

ISSUES = ("Problem with a purchase shown on your statement", "Fees or interest", "Problem when making payments", "Problem with fraud alerts or security")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat_ws("-", *[F.col(p).cast("string") for p in parts])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = _read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.concat(F.lit("product_"), (F.col("c_custkey") % 5).cast("string")).alias("product_type"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.when(F.col("c_acctbal") < 0, "<=660").otherwise(">660").alias("fico_band"),
        F.col("r_name").alias("region"),
        F.lit(1).alias("active_flag"),
        F.col("c_acctbal").alias("current_balance"),
        (F.col("c_acctbal") + 1000).alias("credit_limit"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return rows.select(
        _text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
        _text("l_orderkey", "l_linenumber").alias("source_transaction_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("l_shipdate").alias("transaction_date"),
        F.col("o_orderdate").alias("posted_date"),
        F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("merchant_category"),
        F.col("o_orderpriority").alias("channel"),
        F.when(F.col("l_suppkey") % 13 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("transaction_amount"),
        F.when(F.col("l_linestatus") == "F", "purchase").otherwise("payment").alias("transaction_type"),
        flag(F.col("l_returnflag") == "R").alias("is_disputed"),
        flag(F.col("l_returnflag") == "A").alias("is_fraud_claim"),
        flag(F.col("l_returnflag") == "N").alias("payment_failed"),
        F.concat(F.lit("batch_"), (F.col("l_suppkey") % 9).cast("string")).alias("ingestion_batch_id"),
        F.lit("ledger").alias("source_system"),
        F.col("l_shipdate").alias("created_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money(F.col("o_totalprice"))
    rows = _read(spark, sf_dir, "orders").groupBy(month_of(F.col("o_orderdate")).alias("snapshot_month"), F.col("o_custkey").alias("k"))
    return rows.agg(
        F.sum(price).cast("double").alias("statement_balance"),
        F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("is_30dpd"),
        F.sum(F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 20 == 0), price).otherwise(money(F.lit(0)))).cast("double").alias("charge_off_balance"),
    ).select("snapshot_month", F.col("k").cast("string").alias("account_id"), F.when(F.col("k") % 10 == 0, 0).otherwise(1).alias("active_flag"), "statement_balance", "is_30dpd", "charge_off_balance")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    pick = lambda n: (F.col("doc_id") % n).cast("int")
    return rows.select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        (F.col("doc_id") % 150).cast("string").alias("account_id"),
        F.to_timestamp(F.concat(F.lit("2001-0"), (pick(8) + 1).cast("string"), F.lit("-15"))).alias("date_received"),
        F.col("lang").alias("product"),
        F.element_at(F.array(*map(F.lit, ISSUES)), pick(4) + 1).alias("issue"),
        F.col("text").alias("complaint_narrative"),
        F.col("source").alias("submitted_via"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("merchant_category"),
        F.concat(F.lit("c"), pick(3).cast("string")).alias("channel"),
        F.concat(F.lit("seg"), pick(4).cast("string")).alias("customer_segment"),
        F.when(pick(7) == 0, "<=660").otherwise(">660").alias("fico_band"),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "accounts": accounts(spark, sf_dir),
        "transactions": transactions(spark, sf_dir),
        "account_monthly_snapshot": snapshots(spark, sf_dir),
        "complaints": complaints(spark, sf_dir),
    }
