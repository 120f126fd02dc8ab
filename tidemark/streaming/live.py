"""The core operators over unbounded inputs: replays dropped within a watermark, and rates by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_events(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each event seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_rate(stream: DataFrame, time: str, flag: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, numerator, denominator, value for each window of time."""
    found = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.sum(F.col(flag).cast("long")).alias("numerator"), F.count("*").alias("denominator"))
    return found.select(F.col("w.start").alias("start"), "numerator", "denominator", (F.col("numerator") / F.col("denominator")).alias("value"))
