"""One-row profiles of the raw and the clean lines, and the headline insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig, CleaningRules, month_slug
from tillwise.functions import pct, round2
from tillwise.operators.cleaning import cleaning_steps
from tillwise.operators.rows import mean_of, record_at, records, side_by_side
from tillwise.sources.lines import LINE_COLUMNS

CLEAN_COLUMNS = ["rows", "revenue", "unique_invoices", "customers_including_guest_key", "guest_line_rows", "guest_line_share_pct"]


def profile_raw(lines: DataFrame) -> DataFrame:
    """Size, period, invoices and customers of the raw lines."""
    return _raw_profile(lines, F.count(F.lit(1)), "InvoiceDate", "InvoiceDate")


def profile_raw_of_ledger(ledger: DataFrame) -> DataFrame:
    return _raw_profile(ledger, F.coalesce(F.sum("rows_0"), F.lit(0)), "first_ts", "last_ts")


def _raw_profile(frame: DataFrame, rows: Column, first: str, last: str) -> DataFrame:
    # Exact distinct counts: Spark shuffles by the counted value, so no task holds them all.
    return frame.agg(
        rows.alias("raw_rows"),
        F.lit(len(LINE_COLUMNS)).alias("raw_columns"),
        F.min(first).cast("string").alias("date_min"),
        F.max(last).cast("string").alias("date_max"),
        F.count_distinct("InvoiceNo").alias("raw_unique_invoices"),
        F.count_distinct("CustomerID").alias("raw_unique_customers_non_null"),
    )


def profile_clean(facts: DataFrame) -> DataFrame:
    """Size, revenue, invoices, customers (all guests as one) and guest lines of the clean lines."""
    return _with_guest_share(facts.agg(*_clean_measures(F.col("line_count"))))


def profiles_of_ledger(ledger: DataFrame, totals: DataFrame, rules: CleaningRules) -> DataFrame:
    """One row (raw_profile, clean_profile): both profiles from one pass over a ledger and its totals."""
    passed = F.col(f"rows_{len(cleaning_steps(rules))}")
    raw = [F.count_distinct("InvoiceNo").alias("raw_unique_invoices"), F.count_distinct("CustomerID").alias("raw_unique_customers_non_null")]
    both = side_by_side(totals.select(F.struct("*").alias("t")), ledger.agg(*raw, *_clean_measures(passed, passed > 0)))
    raw_profile = both.select(
        F.struct(
            F.col("t.rows_0").alias("raw_rows"),
            F.lit(len(LINE_COLUMNS)).alias("raw_columns"),
            F.col("t.first_ts").cast("string").alias("date_min"),
            F.col("t.last_ts").cast("string").alias("date_max"),
            "raw_unique_invoices",
            "raw_unique_customers_non_null",
        ).alias("raw_profile"),
        "*",
    )
    shared = _with_guest_share(raw_profile)
    return shared.select("raw_profile", F.struct(*CLEAN_COLUMNS).alias("clean_profile"))


def _clean_measures(lines: Column, clean: Column | None = None) -> list[Column]:
    """The profile's aggregates over the rows that are clean; ``lines`` is how many lines a row stands for."""

    def kept(value: Column) -> Column:
        return value if clean is None else F.when(clean, value)

    is_guest = F.col("CustomerID").isNull()
    any_guest = F.coalesce(F.max(kept(is_guest.cast("bigint"))), F.lit(0))
    return [
        F.coalesce(F.sum(kept(lines)), F.lit(0)).alias("rows"),
        round2(F.sum(kept(F.col("line_revenue")))).alias("revenue"),
        F.count_distinct(kept(F.col("InvoiceNo"))).alias("unique_invoices"),
        (F.count_distinct(kept(F.col("CustomerID"))) + any_guest).alias("customers_including_guest_key"),
        F.coalesce(F.sum(kept(F.when(is_guest, lines))), F.lit(0)).alias("guest_line_rows"),
    ]


def _with_guest_share(totals: DataFrame) -> DataFrame:
    return totals.withColumn("guest_line_share_pct", pct(F.col("guest_line_rows"), F.col("rows")))


def insights(kpi: DataFrame, matrix: DataFrame, guests: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The eight headline values as one row; fewer where a short window has the same month twice.

    A month or cohort without data gives NULL.

    The values are looked up in the same records that the documents list, so a document with both
    computes each table once.
    """
    m = config.months
    tables = side_by_side(
        records(kpi, "monthly_kpi", "order_month"),
        records(matrix, "cohort_retention_matrix", "cohort_month"),
        records(guests, "guest_metrics", "order_month"),
    )
    revenue = [
        record_at("monthly_kpi", "order_month", month, "avg_daily_revenue").alias(
            f"{month_slug(month)}_avg_daily_revenue"
        )
        for month in dict.fromkeys((m.peak, m.last, m.base))
    ]
    guest = [
        record_at("guest_metrics", "order_month", m.peak, name).alias(f"{month_slug(m.peak)}_{name}")
        for name in ("guest_order_share_pct", "guest_revenue_share_pct", "guest_avg_revenue_per_order")
    ]
    cell = f"m{m.cohort_offset}_retention_pct"
    long_retention = record_at("cohort_retention_matrix", "cohort_month", m.cohort, cell)
    return tables.select(
        *revenue,
        *guest,
        long_retention.alias(f"cohort_{m.cohort.replace('-', '_')}_{cell}"),
        # The mean of the rounded cells; cohorts without a first month are left out.
        round2(mean_of("cohort_retention_matrix", "m1_retention_pct")).alias("average_m1_retention_pct"),
    )
