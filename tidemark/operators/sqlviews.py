"""The same KPIs as SQL views, and a comparison of both ways."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drivers, metrics
from tidemark.sources.tables import register, run_script

Tables = Mapping[str, DataFrame]
# In the view, rows without an event key count as one event.
CLEAN = """
CREATE OR REPLACE TEMPORARY VIEW clean_transactions AS
SELECT * EXCEPT (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_transaction_id ORDER BY created_at, transaction_id) AS place FROM transactions
) WHERE place = 1"""
RATE = """
CREATE OR REPLACE TEMPORARY VIEW {view} AS
SELECT date_format(transaction_date, 'yyyy-MM') AS month, count_if({flag} = 1) AS numerator, count(*) AS denominator, count_if({flag} = 1) / count(*) AS value
FROM {source} WHERE transaction_type = '{kind}' GROUP BY 1"""
SEGMENT = """
CREATE OR REPLACE TEMPORARY VIEW {view} AS
SELECT date_format(transaction_date, 'yyyy-MM') AS month, {columns}, count_if(is_disputed = 1) AS numerator, count(*) AS denominator, count_if(is_disputed = 1) / count(*) AS value
FROM clean_transactions WHERE transaction_type = 'purchase' GROUP BY {groups}"""
VIEWS = {
    "monthly_dispute_rate_raw": ("is_disputed", "transactions", "purchase"),
    "monthly_dispute_rate_corrected": ("is_disputed", "clean_transactions", "purchase"),
    "monthly_fraud_claim_rate": ("is_fraud_claim", "clean_transactions", "purchase"),
    "monthly_payment_failure_rate": ("payment_failed", "clean_transactions", "payment"),
}
CUTS = {"segment_merchant_category": ("merchant_category",), "segment_channel": ("channel",), "segment_category_channel": ("merchant_category", "channel")}


def script() -> str:
    rates = [RATE.format(view=v, flag=f, source=s, kind=k) for v, (f, s, k) in VIEWS.items()]
    label = lambda c: f"coalesce(nullif(trim({c}), ''), '__missing__')" if c == "merchant_category" else c
    cuts = [SEGMENT.format(view=v, columns=", ".join(f"{label(c)} AS {c}" for c in cs), groups=", ".join(str(i + 1) for i in range(len(cs) + 1))) for v, cs in CUTS.items()]
    return ";".join([CLEAN, *rates, *cuts])


def create(spark: SparkSession, tables: Tables) -> None:
    register(tables)
    run_script(spark, script())


def read(spark: SparkSession, view: str) -> DataFrame:
    return spark.table(view)


def trend(spark: SparkSession) -> DataFrame:
    """Raw and corrected by month, from the views."""
    side = lambda v, name: spark.table(v).select("month", F.col("numerator").alias(f"{name}_numerator"), F.col("denominator").alias(f"{name}_denominator"), F.col("value").alias(f"{name}_value"))
    return side("monthly_dispute_rate_raw", "raw").join(side("monthly_dispute_rate_corrected", "corrected"), "month", "full").na.fill(0, ["raw_numerator", "raw_denominator", "corrected_numerator", "corrected_denominator"])


def _differences(name: str, a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    both = a.select(*keys, *[F.col(v).cast("double").alias(f"a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).cast("double").alias(f"b_{v}") for v in values]), keys, "full")
    off = reduce(lambda x, y: x | y, [~F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance, F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull()) for v in values])
    return both.agg(F.lit(name).alias("check_name"), F.count("*").alias("compared"), F.coalesce(F.sum(off.cast("int")), F.lit(0)).cast("long").alias("differences")).withColumn("matches", F.col("differences") == 0)


def parity(spark: SparkSession, tables: Tables, tolerance: float = 1e-9) -> DataFrame:
    """One row for each of seven comparisons of the views with the DataFrame operators."""
    create(spark, tables)
    value = ["numerator", "denominator", "value"]
    found = []
    for view, kpi, corrected in (("monthly_dispute_rate_raw", "dispute_rate", False), ("monthly_dispute_rate_corrected", "dispute_rate", True), ("monthly_fraud_claim_rate", "fraud_claim_rate", True), ("monthly_payment_failure_rate", "payment_failure_rate", True)):
        found.append(_differences(view, spark.table(view), metrics.monthly(tables, kpi, corrected), ["month"], value, tolerance))
    facts = drivers.purchase_facts(tables)
    for view, keys in CUTS.items():
        own = facts.groupBy("month", *keys).agg(F.sum("is_disputed").alias("numerator"), F.count("*").alias("denominator")).withColumn("value", F.col("numerator") / F.col("denominator"))
        found.append(_differences(view, spark.table(view), own, ["month", *keys], value, tolerance))
    return reduce(DataFrame.unionByName, found)
