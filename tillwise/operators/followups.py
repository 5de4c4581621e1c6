"""Follow-up questions the report leaves open; the definitions are our own.

All of them rank or threshold aggregated rows. Top-k lists use a distributed top-k, never a window
over all products or orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig, CleaningRules, DayWindow
from tillwise.functions import day_range, month_text, pct, ratio, round2
from tillwise.operators.cleaning import clean, line_revenue
from tillwise.operators.ranks import exact_quantile

RECONTACT_DAYS = (7, 21, 30)


def top_products(lines: DataFrame, rules: CleaningRules, month: DayWindow, k: int = 20) -> DataFrame:
    """The k products with the highest revenue in a month and their share of that month."""
    per_product = (
        clean(lines.filter(day_range(F.col("InvoiceDate"), month)), rules)
        .groupBy("StockCode")
        .agg(F.sum(line_revenue()).alias("revenue"), F.sum("Quantity").alias("units"))
    )
    # Both totals read exactly what the ranking reads, so the aggregation is shuffled only once.
    total = per_product.agg(F.struct(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"))).scalar()
    best_first = [F.col("revenue").desc(), F.col("StockCode")]
    # The limit keeps k rows before the rank is taken over all of them.
    top = per_product.orderBy(*best_first).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(*best_first)).alias("rank"),
        "StockCode",
        "units",
        round2(F.col("revenue")).alias("revenue"),
        pct(F.col("revenue"), total.getField("revenue")).alias("revenue_share_pct"),
        pct(F.col("units"), total.getField("units")).alias("units_share_pct"),
    )


def country_kpi(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """Orders, identified customers and revenue per country, with its share of the total."""
    per_order = (
        clean(lines, rules)
        .groupBy("Country", "InvoiceNo", "CustomerID")
        .agg(F.sum(line_revenue()).alias("revenue"), F.count(F.lit(1)).alias("lines"))
    )
    per_country = per_order.groupBy("Country").agg(
        F.sum("lines").alias("lines"),
        F.count_distinct("InvoiceNo").alias("orders"),
        F.count_distinct("CustomerID").alias("members"),
        F.sum("revenue").alias("revenue"),
    )
    # One row per country, so the window over all of them is small.
    total = F.sum("revenue").over(Window.partitionBy())
    return per_country.select(
        "Country",
        "lines",
        "orders",
        "members",
        round2(F.col("revenue")).alias("revenue"),
        pct(F.col("revenue"), total).alias("revenue_share_pct"),
    )


def guest_orders(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """One row per guest invoice: first month and country, lines, units and revenue."""
    return (
        clean(lines, rules)
        .groupBy("InvoiceNo")
        .agg(
            F.bool_and(F.col("CustomerID").isNull()).alias("is_guest"),
            F.min("InvoiceDate").alias("first_ts"),
            F.min("Country").alias("country"),
            F.count(F.lit(1)).alias("lines"),
            F.sum("Quantity").alias("units"),
            F.sum(line_revenue()).alias("order_revenue"),
        )
        .filter("is_guest")
        .select(
            "InvoiceNo",
            month_text(F.col("first_ts")).alias("order_month"),
            "country",
            "lines",
            "units",
            "order_revenue",
        )
    )


def high_value_guests(orders: DataFrame, q: float = 0.9) -> DataFrame:
    """Guest orders at or above the exact q-quantile of guest order revenue: a list of leads.

    The orders are read three times, twice of them here; stage them first.
    """
    threshold = F.lit(exact_quantile(orders, "order_revenue", q)).cast(orders.schema["order_revenue"].dataType)
    return orders.filter(F.col("order_revenue") >= threshold).withColumn("threshold", round2(threshold))


def guest_leads_by(leads: DataFrame, key: Column, name: str) -> DataFrame:
    """High-value guest orders per country, order size or any other key."""
    return leads.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("units").alias("units"),
        round2(F.sum("order_revenue")).alias("revenue"),
        round2(ratio(F.sum("order_revenue"), F.count(F.lit(1)))).alias("avg_order_revenue"),
    )


def order_size_band() -> Column:
    units = F.col("units")
    return F.when(units < 50, "under 50").when(units < 200, "50-199").otherwise("200 and more")


def guest_lead_products(lines: DataFrame, rules: CleaningRules, leads: DataFrame) -> DataFrame:
    """Products in the high-value guest orders: in how many orders, units and revenue.

    Lines are combined to one row per order and product before the join, so the line count of an
    order has no bearing on it.
    """
    per_order = (
        clean(lines, rules)
        .filter(F.col("CustomerID").isNull())
        .groupBy("InvoiceNo", "StockCode")
        .agg(F.sum("Quantity").alias("units"), F.sum(line_revenue()).alias("revenue"))
        .join(leads.select("InvoiceNo"), "InvoiceNo", "left_semi")
    )
    return per_order.groupBy("StockCode").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("units").alias("units"), round2(F.sum("revenue")).alias("revenue")
    )


def member_returns(facts: DataFrame) -> DataFrame:
    """First and second purchase day of every member; the second is NULL without a return."""
    return _returns(facts.filter(F.col("CustomerID").isNotNull()).select("CustomerID", "order_date").distinct())


def _returns(days: DataFrame) -> DataFrame:
    """The same from distinct purchase days, which the calendar bounds, so that the window over one member is small."""
    by_day = Window.partitionBy("CustomerID").orderBy("order_date")
    return (
        days.select(
            "CustomerID",
            F.col("order_date").alias("first_day"),
            F.lead("order_date").over(by_day).alias("second_day"),
            F.row_number().over(by_day).alias("nth"),
        )
        .filter("nth = 1")
        .drop("nth")
    )


def repeat_vs_one_time(lines: DataFrame, rules: CleaningRules, last_day: Column) -> DataFrame:
    """Per product of a member's first purchase day: buyers who came back within 30 and 60 days.

    A share counts buyers whose 30 or 60 days are observed in full only. Lines are reduced once to distinct
    (member, day, product), and baskets and returns both derive from these; a product belongs to the
    first purchase if it was bought on the member's first day.
    """
    bought = (
        clean(lines, rules)
        .filter(F.col("CustomerID").isNotNull())
        .select("CustomerID", F.to_date("InvoiceDate").alias("order_date"), "StockCode")
        .distinct()
    )
    returns = _returns(bought.select("CustomerID", "order_date").distinct())
    first_basket = bought.join(returns, "CustomerID").filter(F.col("order_date") == F.col("first_day"))
    gap = F.date_diff("second_day", "first_day")
    counts, shares = [], []
    for n in (30, 60):
        observed = F.date_add("first_day", n) <= last_day
        counts += [F.count_if(observed).alias(f"observed_{n}"), F.count_if(observed & (gap <= n)).alias(f"back_in_{n}")]
        shares.append(pct(F.col(f"back_in_{n}"), F.col(f"observed_{n}")).alias(f"back_in_{n}_pct"))
    counted = first_basket.groupBy("StockCode").agg(
        F.count(F.lit(1)).alias("first_buyers"), *counts, F.count_if(F.col("second_day").isNull()).alias("one_time_buyers")
    )
    return counted.select("*", *shares)


def recontact_list(facts: DataFrame, last_day: Column) -> DataFrame:
    """Members to contact 7, 21 and 30 days after their first purchase.

    A contact is due if the member has not bought again up to that day and the day is observed.
    """
    observed = F.col("contact_day") <= last_day
    not_back = F.col("second_day").isNull() | (F.col("second_day") > F.col("contact_day"))
    return (
        member_returns(facts)
        .withColumn("after_days", F.explode(F.array(*[F.lit(d) for d in RECONTACT_DAYS])))
        .withColumn("contact_day", F.date_add("first_day", F.col("after_days")))
        .filter(observed & not_back)
        .select(F.col("CustomerID").cast("string").alias("customer_id"), "first_day", "after_days", "contact_day")
    )


def seasonality(lines: DataFrame, rules: CleaningRules, group: Column) -> DataFrame:
    """Revenue of a product group per month and its share of that group's year."""
    monthly = (
        clean(lines, rules)
        .groupBy(group.alias("product_group"), F.trunc("InvoiceDate", "month").alias("month_start"))
        .agg(F.sum(line_revenue()).alias("revenue"))
        .withColumn("year", F.year("month_start"))
    )
    of_year = F.sum("revenue").over(Window.partitionBy("product_group", "year"))
    return monthly.select(
        "product_group",
        month_text(F.col("month_start")).alias("order_month"),
        round2(F.col("revenue")).alias("revenue"),
        pct(F.col("revenue"), of_year).alias("share_of_year_pct"),
    )


def censoring_flags(retention: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Retention cells with their two blind spots.

    The first cohort may hold customers from before the window; a cell that falls into a last
    month cut off by the window counts too few returns.
    """
    cell_month = F.add_months(F.to_date(F.concat("cohort_month", F.lit("-01"))), F.col("month_diff"))
    in_last = month_text(cell_month) == config.window.last_month
    return retention.select(
        "cohort_month",
        "month_diff",
        "retention_rate",
        (F.col("cohort_month") == config.window.first_month).alias("is_left_truncated"),
        (in_last & F.lit(config.window.last_month_is_partial)).alias("is_partial_month"),
    )


def weak_months(kpi: DataFrame) -> DataFrame:
    """Months whose average daily revenue is below the mean over all months."""
    # One row per month, so the window over all of them is small.
    all_months = Window.partitionBy()
    mean = ratio(F.sum("avg_daily_revenue").over(all_months), F.count(F.lit(1)).over(all_months))
    compared = kpi.withColumn("mean", mean).withColumn("gap", F.col("avg_daily_revenue") - F.col("mean"))
    return compared.filter("gap < 0").select(
        "order_month", "avg_daily_revenue", pct(F.col("gap"), F.col("mean")).alias("gap_to_mean_pct")
    )
