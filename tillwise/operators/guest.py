"""Orders without a customer id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import month_text, pct, ratio, round2


def order_level(facts: DataFrame) -> DataFrame:
    """One row per month and invoice. An order is a guest order if none of its lines has an id.

    An invoice with lines in two months is an order in each of them.
    """
    return (
        facts.withColumn("month_start", F.trunc("order_date", "month"))
        .groupBy("month_start", "InvoiceNo")
        .agg(
            F.sum("line_revenue").alias("order_revenue"),
            F.bool_and(F.col("CustomerID").isNull()).alias("is_guest"),
        )
        .select(month_text(F.col("month_start")).alias("order_month"), "InvoiceNo", "order_revenue", "is_guest")
    )


def guest_metrics(orders: DataFrame) -> DataFrame:
    """Share of guest orders per month in number and revenue. No row for a month without orders."""
    guest_revenue = F.sum(F.when(F.col("is_guest"), F.col("order_revenue")).otherwise(0))
    totals = orders.groupBy("order_month").agg(
        F.count_if("is_guest").alias("guest_orders"),
        F.count(F.lit(1)).alias("total_orders"),
        guest_revenue.alias("guest_revenue"),
        F.sum("order_revenue").alias("total_revenue"),
    )
    return totals.select(
        "order_month",
        "guest_orders",
        "total_orders",
        pct(F.col("guest_orders"), F.col("total_orders")).alias("guest_order_share_pct"),
        pct(F.col("guest_revenue"), F.col("total_revenue")).alias("guest_revenue_share_pct"),
        round2(ratio(F.col("guest_revenue"), F.col("guest_orders"))).alias("guest_avg_revenue_per_order"),
    )
