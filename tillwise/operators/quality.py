"""Data quality: the cleaning funnel, the effect of the outlier rule, and a check of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.config import AnalysisConfig, CleaningRules, DayWindow, month_name
from tillwise.functions import day_range, month_text, pct, ratio, round2
from tillwise.operators.calendar import calendar
from tillwise.operators.cleaning import (
    cleaning_steps,
    is_clean_but_for_outliers,
    is_outlier,
    line_revenue,
    step_descriptions,
    steps_passed,
)
from tillwise.operators.rows import side_by_side


def step_counts(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """One row: rows_0 raw lines, rows_n lines left after n rules. One pass over the lines."""
    counts = range(len(cleaning_steps(rules)) + 1)
    passed = lines.select(steps_passed(rules).alias("passed"))
    return passed.agg(*[F.count_if(F.col("passed") >= n).alias(f"rows_{n}") for n in counts])


def step_counts_of_ledger(ledger: DataFrame, rules: CleaningRules) -> DataFrame:
    """The same one row from a compacted ledger; 0 instead of NULL for an empty one."""
    counts = range(len(cleaning_steps(rules)) + 1)
    return ledger.agg(*[F.coalesce(F.sum(f"rows_{n}"), F.lit(0)).alias(f"rows_{n}") for n in counts])


def quality_steps(counts: DataFrame, rules: CleaningRules) -> DataFrame:
    """The funnel as rows, in rule order: what each step leaves and removes."""
    return counts.select(F.inline(_funnel(rules)))


def quality_records(counts: DataFrame, rules: CleaningRules) -> DataFrame:
    """The funnel as one row holding the ordered array of its steps."""
    return counts.select(_funnel(rules).alias("data_quality"))


def step_rows(counts: DataFrame, rules: CleaningRules) -> DataFrame:
    """The funnel in its short form: step_order, step_name, rows_remaining."""
    rows = [
        F.struct(
            F.lit(n + 1).alias("step_order"),
            F.lit(name).alias("step_name"),
            F.col(f"rows_{n}").alias("rows_remaining"),
        )
        for n, name in enumerate(step_descriptions(rules))
    ]
    return counts.select(F.inline(F.array(*rows)))


def _funnel(rules: CleaningRules) -> Column:
    rows = []
    for n, (name, description) in enumerate(step_descriptions(rules).items()):
        left, before = F.col(f"rows_{n}"), F.col(f"rows_{max(n - 1, 0)}")
        rows.append(
            F.struct(
                F.lit(name).alias("step"),
                F.lit(description).alias("description"),
                left.alias("rows_remaining"),
                (before - left).alias("rows_removed_from_previous"),
                pct(left, F.col("rows_0")).alias("rows_remaining_pct"),
            )
        )
    return F.array(*rows)


def steps_by_lag(rows: DataFrame) -> DataFrame:
    """Removed rows and share from the short funnel form, for counts that come as rows.

    The window has no partition key; it runs over one row per step.
    """
    in_order = Window.orderBy("step_order")
    left = F.col("rows_remaining")
    first = F.first("rows_remaining").over(in_order)
    return rows.withColumns(
        {
            "rows_removed_from_previous": F.coalesce(F.lag("rows_remaining").over(in_order) - left, F.lit(0)),
            "rows_remaining_pct": pct(left, first),
        }
    )


def revenue_by_rule(lines: DataFrame, rules: CleaningRules, days: DayWindow) -> DataFrame:
    """Revenue of the lines of some days, without and with the outlier rule.

    The days are filtered in the scan.
    """
    kept = ~F.col("Quantity").isin(*rules.outlier_quantities)
    return lines.filter(day_range(F.col("InvoiceDate"), days) & is_clean_but_for_outliers(rules)).select(
        F.to_date("InvoiceDate").alias("order_date"),
        line_revenue().alias("without_rule"),
        F.when(kept, line_revenue()).alias("with_rule"),
    )


def revenue_by_rule_of_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "order_date", F.col("revenue_with_outliers").alias("without_rule"), F.col("line_revenue").alias("with_rule")
    )


def outlier_sensitivity(revenue: DataFrame, days: DayWindow) -> DataFrame:
    """Average daily revenue of one month without and with the outlier rule; empty days count as 0."""

    def average(name: str) -> Column:
        return round2(ratio(F.sum(F.coalesce(name, F.lit(0))), F.count(F.lit(1))))

    daily = (
        revenue.filter(F.col("order_date").between(F.lit(days.start), F.lit(days.end)))
        .groupBy("order_date")
        .agg(F.sum("without_rule").alias("without_rule"), F.sum("with_rule").alias("with_rule"))
    )
    # At most one row per day of the month.
    return (
        calendar(revenue.sparkSession, days)
        .join(F.broadcast(daily), "order_date", "left")
        .groupBy("order_month")
        .agg(
            average("without_rule").alias("avg_daily_revenue_without_filter"),
            average("with_rule").alias("avg_daily_revenue_with_filter"),
        )
    )


def outlier_rows(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    """The lines that only the outlier rule removes."""
    return lines.filter(is_outlier(rules)).select(
        "InvoiceNo",
        "StockCode",
        "InvoiceDate",
        month_text(F.col("InvoiceDate")).alias("order_month"),
        "Quantity",
        "UnitPrice",
        line_revenue().alias("line_revenue"),
    )


def costliest_outlier(lines: DataFrame, rules: CleaningRules, days: DayWindow) -> DataFrame:
    """One row: the outlier line of a month with the highest revenue; NULLs if there is none."""
    return _costliest(outlier_rows(lines.filter(day_range(F.col("InvoiceDate"), days)), rules))


def costliest_outlier_of_ledger(ledger: DataFrame, rules: CleaningRules, days: DayWindow) -> DataFrame:
    """The same row from a compacted ledger."""
    found = [
        F.struct(F.lit(q).alias("Quantity"), F.col(f"outlier_revenue_{q}").alias("line_revenue"))
        for q in rules.outlier_quantities
    ]
    in_month = ledger.filter(F.col("order_date").between(F.lit(days.start), F.lit(days.end)))
    return _costliest(in_month.select("InvoiceNo", F.inline(F.array(*found))).filter("line_revenue is not null"))


def _costliest(rows: DataFrame) -> DataFrame:
    top = F.max_by(F.struct("InvoiceNo", "Quantity", "line_revenue"), F.struct("line_revenue", "InvoiceNo", "Quantity"))
    return rows.agg(top.alias("top")).select(
        F.col("top.InvoiceNo").alias("outlier_invoice"),
        F.col("top.Quantity").alias("outlier_quantity"),
        round2(F.col("top.line_revenue")).alias("outlier_revenue"),
    )


def consistency_note(sensitivity: DataFrame, outlier: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Both averages of the base month and the line that makes the difference, as one row."""
    prefix = f"{month_name(config.months.base)}_avg_daily_revenue"
    averages = sensitivity.select(
        F.col("avg_daily_revenue_without_filter").alias(f"{prefix}_without_quantity_outlier_filter"),
        F.col("avg_daily_revenue_with_filter").alias(f"{prefix}_with_quantity_outlier_filter"),
    )
    return side_by_side(averages, outlier)


def output_check(result: DataFrame) -> DataFrame:
    """Per column of a result: how many values are NULL, NaN or infinite. One pass."""
    return output_check_rows(result.agg(*output_measures(result.schema)), result.schema)


def output_measures(schema: T.StructType) -> list[Column]:
    """The counts of an output check as aggregates."""
    counts = []
    for position, field in enumerate(schema):
        value = F.col(f"`{field.name}`")
        floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        infinite = value.isin(float("inf"), float("-inf"))
        parts = {
            "null_count": F.count_if(value.isNull()),
            "nan_count": F.count_if(F.isnan(value)) if floating else F.count_if(F.lit(False)),
            "infinite_count": F.count_if(infinite) if floating else F.count_if(F.lit(False)),
        }
        counts += [part.alias(f"{name}_{position}") for name, part in parts.items()]
    return counts


def output_check_rows(counts: DataFrame, schema: T.StructType) -> DataFrame:
    """The row of counts as one row per column."""
    names = ("null_count", "nan_count", "infinite_count")
    rows = [
        F.struct(F.lit(field.name).alias("column_name"), *[F.col(f"{name}_{position}").alias(name) for name in names])
        for position, field in enumerate(schema)
    ]
    return counts.select(F.inline(F.array(*rows)))
