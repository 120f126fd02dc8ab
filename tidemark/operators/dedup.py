"""Replayed source events: the earliest row of each event stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY, ORDER = "source_transaction_id", ("created_at", "transaction_id")


def flag_kept(tx: DataFrame) -> DataFrame:
    """tx with kept: the first by creation time, then identifier. Rows without an event key are all kept.

    Null keys get a partition of their own each, so they don't meet in one task.
    """
    spread = F.when(F.col(KEY).isNull(), F.col("transaction_id"))
    first = F.row_number().over(W.partitionBy(KEY, spread).orderBy(*ORDER)) == 1
    return tx.withColumn("kept", first | F.col(KEY).isNull())


def deduplicate(tx: DataFrame) -> DataFrame:
    return flag_kept(tx).filter("kept").drop("kept")


def removed(tx: DataFrame) -> DataFrame:
    return flag_kept(tx).filter(~F.col("kept")).drop("kept")


def duplicate_summary(tx: DataFrame) -> DataFrame:
    """Surplus rows and events that occur more than once. Repeated null keys count as repeats here."""
    per_key = tx.groupBy(KEY).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("rows_involved"))


def top_batches(tx: DataFrame, k: int = 3) -> DataFrame:
    """The batches with most rows of events that occur more than once."""
    repeated = tx.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(KEY).alias("k"))
    return tx.join(repeated, F.col(KEY).eqNullSafe(F.col("k")), "left_semi").groupBy("ingestion_batch_id").agg(F.count("*").alias("duplicate_rows")).orderBy(F.desc("duplicate_rows"), "ingestion_batch_id").limit(k)
