"""Facts: the narrow input of the KPI, cohort and guest analyses.

A facts frame has the columns order_date, InvoiceNo, CustomerID, line_revenue and line_count. It
comes either at line grain, or compacted to one row per (day, invoice, customer). Sums, minima,
"all lines" tests and distinct counts give the same result on both, so every analysis accepts
either. One analysis alone reads the lines directly; several share one compacted ledger and thus
one scan of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.config import CleaningRules
from tillwise.operators.cleaning import clean, cleaning_steps, line_revenue, steps_passed

GRAIN = ["order_date", "InvoiceNo", "CustomerID"]
FACT_INPUT = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


def line_facts(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """Clean lines as facts, one row each."""
    return clean(lines, rules).select(
        F.to_date("InvoiceDate").alias("order_date"),
        "InvoiceNo",
        "CustomerID",
        line_revenue().alias("line_revenue"),
        F.lit(1).cast("bigint").alias("line_count"),
    )


def order_ledger(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """All lines, cleaned or not, compacted to one row per (day, invoice, customer).

    Each measure is a conditional sum, so the rows are combined before they are shuffled and a hot
    invoice or customer reaches the shuffle as one row per input task. ``rows_0`` counts the raw
    lines and ``rows_n`` those that pass the first n rules; ``outlier_revenue_q`` is the costliest line
    that only the outlier rule removes, per listed quantity.
    """
    last = len(cleaning_steps(rules))
    passed = F.col("passed")
    return (
        lines.select(
            F.to_date("InvoiceDate").alias("order_date"),
            "InvoiceNo",
            "CustomerID",
            "InvoiceDate",
            "Quantity",
            line_revenue().alias("revenue"),
            steps_passed(rules).alias("passed"),
        )
        .groupBy(*GRAIN)
        .agg(
            *[F.count_if(passed >= n).alias(f"rows_{n}") for n in range(last + 1)],
            F.min("InvoiceDate").alias("first_ts"),
            F.max("InvoiceDate").alias("last_ts"),
            F.sum(F.when(passed >= last - 1, F.col("revenue"))).alias("revenue_with_outliers"),
            F.sum(F.when(passed >= last, F.col("revenue"))).alias("line_revenue"),
            *[
                F.max(F.when((passed == last - 1) & (F.col("Quantity") == q), F.col("revenue"))).alias(f"outlier_revenue_{q}")
                for q in rules.outlier_quantities
            ],
        )
    )


def ledger_totals(rules: CleaningRules) -> list[Column]:
    """What a ledger says of all lines without distinct counts: rows_n, as in the ledger, and first_ts and last_ts."""
    rows = [F.coalesce(F.sum(f"rows_{n}"), F.lit(0)).alias(f"rows_{n}") for n in range(len(cleaning_steps(rules)) + 1)]
    return [*rows, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]


def ledger_facts(ledger: DataFrame, rules: CleaningRules) -> DataFrame:
    """The clean part of a ledger as facts."""
    passed = F.col(f"rows_{len(cleaning_steps(rules))}")
    return ledger.filter(passed > 0).select(*GRAIN, "line_revenue", passed.alias("line_count"))


def compact(facts: DataFrame) -> DataFrame:
    """Facts at line grain as one row per (day, invoice, customer)."""
    return facts.groupBy(*GRAIN).agg(F.sum("line_revenue").alias("line_revenue"), F.sum("line_count").alias("line_count"))
