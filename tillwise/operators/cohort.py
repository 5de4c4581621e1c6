"""First-purchase cohorts and their retention. Only members take part: guests cannot be followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig
from tillwise.functions import month_diff, month_text, month_text_of_index, pct
from tillwise.operators.activity import MonthRange, cohort_counts, member_activity, member_offsets, observed_months


def first_orders(facts: DataFrame) -> DataFrame:
    """First order day and cohort month of every member."""
    return (
        facts.filter(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.min("order_date").alias("first_order_date"))
        .select(
            F.col("CustomerID").cast("string").alias("customer_id"),
            "first_order_date",
            month_text(F.col("first_order_date")).alias("cohort_month"),
        )
    )


def orders_with_cohort(facts: DataFrame, months: MonthRange | None = None) -> DataFrame:
    """One row per member and active month. ``months`` as for ``cohort_retention``."""
    months = months or observed_months(facts)
    return member_offsets(member_activity(facts, months), months).select(
        F.col("CustomerID").cast("string").alias("customer_id"),
        month_text_of_index(F.col("cohort")).alias("cohort_month"),
        "month_diff",
    )


def join_first_orders(facts: DataFrame) -> DataFrame:
    """Every distinct (member, day) with the member's first order, by an equi-join on the numeric id.

    Both sides derive from the distinct days, so the lines are read and reduced once.
    """
    days = facts.filter(F.col("CustomerID").isNotNull()).select("CustomerID", "order_date").distinct()
    firsts = days.groupBy("CustomerID").agg(F.min("order_date").alias("first_order_date"))
    return days.join(firsts, "CustomerID").select(
        F.col("CustomerID").cast("string").alias("customer_id"),
        "order_date",
        "first_order_date",
        month_text(F.col("first_order_date")).alias("cohort_month"),
        month_diff(F.col("order_date"), F.col("first_order_date")).alias("month_diff"),
    )


def cohort_sizes(firsts: DataFrame) -> DataFrame:
    """Members per cohort; the input has one row per member, so a plain count is exact."""
    return firsts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("new_users"))


def cohort_retention(facts: DataFrame, config: AnalysisConfig, months: MonthRange | None = None) -> DataFrame:
    """Members of each cohort who were active again after 0..max months. No row where none was.

    Counted from the bits of one row per member. ``months`` must cover all facts; without it a job looks for their first and
    last month.
    """
    months = months or observed_months(facts)
    counts = cohort_counts(member_activity(facts, months), months, config.max_month_diff)
    return counts.select(
        month_text_of_index(F.col("cohort")).alias("cohort_month"),
        "month_diff",
        "retained_users",
        "new_users",
        pct(F.col("retained_users"), F.col("new_users")).alias("retention_rate"),
    )


def cohort_matrix(retention: DataFrame, config: AnalysisConfig) -> DataFrame:
    """One row per cohort, one column per later month; NULL where nobody was observed."""
    cells = [
        F.max(F.when(F.col("month_diff") == k, F.col("retention_rate"))).alias(f"m{k}_retention_pct")
        for k in config.matrix_offsets
    ]
    return retention.groupBy("cohort_month", "new_users").agg(*cells)
