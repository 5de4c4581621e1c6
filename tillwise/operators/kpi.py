"""Daily statistics and the average-per-day monthly KPI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.config import DayWindow
from tillwise.functions import pct_change, ratio, round2
from tillwise.operators.calendar import calendar

KPI_COLUMNS = ["avg_daily_revenue", "avg_daily_customers", "avg_daily_orders"]


def daily_stats(facts: DataFrame, window: DayWindow) -> DataFrame:
    """Revenue, customers and orders of every day in the window; 0 on days without lines.

    All guests of a day count as one customer. Both distinct counts are exact and share one pass:
    Spark keys their shuffle by the counted value as well as the day, after dropping duplicates on
    the map side, so one huge day or invoice is spread over many tasks.
    """
    has_guests = F.max(F.col("CustomerID").isNull().cast("bigint"))
    per_day = (
        facts.filter(F.col("order_date").between(F.lit(window.start), F.lit(window.end)))
        .groupBy("order_date")
        .agg(
            F.sum("line_revenue").alias("daily_revenue"),
            (F.count_distinct("CustomerID") + has_guests).alias("daily_customers"),
            F.count_distinct("InvoiceNo").alias("daily_orders"),
        )
    )
    # At most one row per day of the window, hence never more rows than the calendar has.
    return calendar(facts.sparkSession, window).join(F.broadcast(per_day), "order_date", "left").select(
        "order_date",
        "order_month",
        F.coalesce("daily_revenue", F.lit(0)).alias("daily_revenue"),
        F.coalesce("daily_customers", F.lit(0)).alias("daily_customers"),
        F.coalesce("daily_orders", F.lit(0)).alias("daily_orders"),
    )


def monthly_kpi(daily: DataFrame) -> DataFrame:
    """Averages per calendar day of each month."""
    averages = [
        round2(ratio(F.sum(f"daily_{what}"), F.count(F.lit(1)))).alias(f"avg_daily_{what}")
        for what in ("revenue", "customers", "orders")
    ]
    return daily.groupBy("order_month").agg(*averages)


def add_mom(kpi: DataFrame) -> DataFrame:
    """Change of the rounded averages against the previous month, in percent.

    The window has no partition key; it runs over one row per month.
    """
    by_month = Window.orderBy("order_month")
    changes = {
        f"{name.removeprefix('avg_daily_')}_mom_pct": pct_change(F.col(name), F.lag(name).over(by_month))
        for name in KPI_COLUMNS
    }
    return kpi.withColumns(changes)
