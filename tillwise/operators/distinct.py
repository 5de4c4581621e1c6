"""Exact distinct counts over several grains from one mergeable table of bitmaps.

Per day the table holds the day's invoices and customers as bitmaps of 64 ids each, and its sums. Bitmaps of days combine with OR, so
month, year and whole follow from the days without going back to the lines, and a day that is added or replaced changes its own rows alone.
A counted key is a bit if it is a whole number from 0 on, written without leading zeros; any other key, as that of all guests, has a row
of its own, so that counts are exact whatever the keys are.

A bitmap is one word, so a day whose ids are scattered over a wide range takes a row a key at most, and a day whose ids stand
together one row for 64 of them. The table never takes more rows than there are different keys a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.config import DayWindow
from tillwise.functions import pct, round2
from tillwise.operators.calendar import calendar
from tillwise.operators.cleaning import customer_key

KEYS = ["kind", "bucket", "key"]
WORD_IDS = 64


def distinct_state(facts: DataFrame) -> DataFrame:
    """(order_date, kind, bucket, key, bits, revenue, lines, guest_lines), a row per day, kind and bitmap or odd key.

    ``kind`` is invoice, customer, or total for the row with the day's sums. One pass over the facts and one shuffle.
    """
    nothing = F.lit(None).cast("string")
    guest = F.col("CustomerID").isNull()
    entries = F.array(
        F.struct(F.lit("invoice").alias("kind"), F.col("InvoiceNo").alias("text")),
        F.struct(F.lit("customer").alias("kind"), customer_key().alias("text")),
        F.struct(F.lit("total").alias("kind"), nothing.alias("text")),
    )
    measures = {"revenue": F.col("line_revenue"), "lines": F.col("line_count"), "guest_lines": F.when(guest, F.col("line_count"))}
    exploded = facts.select("order_date", *[value.alias(name) for name, value in measures.items()], F.inline(entries))
    # A NULL invoice is no invoice.
    counted = exploded.filter((F.col("kind") == "total") | F.col("text").isNotNull())
    number = F.col("text").try_cast("bigint")
    number = F.when((number >= 0) & (number.cast("string") == F.col("text")), number)
    keyed = counted.withColumn("id", number).select(
        "order_date",
        "kind",
        F.expr(f"id DIV {WORD_IDS}").alias("bucket"),
        F.when(F.col("id").isNull(), F.col("text")).alias("key"),
        F.expr(f"shiftleft(1L, CAST(id % {WORD_IDS} AS INT))").alias("bit"),
        *[F.when(F.col("kind") == "total", F.col(name)).alias(name) for name in measures],
    )
    return keyed.groupBy("order_date", *KEYS).agg(F.bit_or("bit").alias("bits"), *[F.sum(name).alias(name) for name in measures])


def merged(state: DataFrame, *grain: Column) -> DataFrame:
    """The table over a coarser grain, expressions of ``order_date``; without any, over all days."""
    sums = [F.sum(name).alias(name) for name in ("revenue", "lines", "guest_lines")]
    return state.groupBy(*grain, *KEYS).agg(F.bit_or("bits").alias("bits"), *sums)


def distinct(kind: str) -> Column:
    """The number of distinct keys of a kind, as an aggregate over rows of the table."""
    keys = F.when(F.col("key").isNotNull(), F.lit(1).cast("long")).otherwise(F.coalesce(F.bit_count("bits").cast("long"), F.lit(0)))
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, keys)), F.lit(0).cast("long"))


def daily_stats(state: DataFrame, window: DayWindow) -> DataFrame:
    """The same rows as ``kpi.daily_stats``."""
    per_day = (
        state.filter(F.col("order_date").between(F.lit(window.start), F.lit(window.end)))
        .groupBy("order_date")
        .agg(F.sum("revenue").alias("revenue"), distinct("customer").alias("customers"), distinct("invoice").alias("orders"))
    )
    # At most one row per day of the window.
    return calendar(state.sparkSession, window).join(F.broadcast(per_day), "order_date", "left").select(
        "order_date",
        "order_month",
        F.coalesce("revenue", F.lit(0)).alias("daily_revenue"),
        F.coalesce("customers", F.lit(0)).alias("daily_customers"),
        F.coalesce("orders", F.lit(0)).alias("daily_orders"),
    )


def profile_clean(state: DataFrame) -> DataFrame:
    """The same row as ``profile.profile_clean``."""
    totals = merged(state).agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"),
        round2(F.sum("revenue")).alias("revenue"),
        distinct("invoice").alias("unique_invoices"),
        distinct("customer").alias("customers_including_guest_key"),
        F.coalesce(F.sum("guest_lines"), F.lit(0)).alias("guest_line_rows"),
    )
    return totals.withColumn("guest_line_share_pct", pct(F.col("guest_line_rows"), F.col("rows")))
