"""The day calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.config import DayWindow
from tillwise.functions import month_text


def calendar(spark: SparkSession, window: DayWindow) -> DataFrame:
    """One row per day of the window: order_date, order_month."""
    bounds = spark.range(1).select(
        F.lit(window.start).cast("date").alias("first"), F.lit(window.end).cast("date").alias("last")
    )
    return _days(bounds)


def observed_calendar(lines: DataFrame) -> DataFrame:
    """One row per day from the first to the last day on which a line was recorded."""
    days = F.to_date("InvoiceDate")
    return _days(lines.agg(F.min(days).alias("first"), F.max(days).alias("last")))


def _days(bounds: DataFrame) -> DataFrame:
    day = F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("order_date")
    return bounds.select(day).withColumn("order_month", month_text(F.col("order_date")))
