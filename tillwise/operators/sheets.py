"""Ready-to-show feeds: the data behind each sheet of the report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig, month_bounds, month_slug
from tillwise.fixed_values import (
    CARDS,
    CONSISTENCY_SENTENCE,
    GUEST_HEADERS,
    LOWEST_BAND,
    MONTHLY_HEADERS,
    QUALITY_HEADERS,
    RETENTION_BANDS,
    RETENTION_CELL_HEADER,
    RETENTION_HEADERS,
    STEP_LABELS,
)
from tillwise.functions import band, fill, label_of, percent_text, thousands
from tillwise.operators.rows import side_by_side


def sheet_monthly(kpi: DataFrame) -> DataFrame:
    return kpi.select(*MONTHLY_HEADERS)


def sheet_guest(guests: DataFrame) -> DataFrame:
    """Shares first, counts last."""
    return guests.select(*GUEST_HEADERS)


def sheet_retention(matrix: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The matrix in reading order: cohort, size, one column per later month."""
    return matrix.select(*retention_headers(config))


def retention_bands(matrix: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The matrix one cell per row, with the heat band of each cell; blank cells have none."""
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("month_diff"), F.col(f"m{k}_retention_pct").alias("retention_pct"))
            for k in config.matrix_offsets
        ]
    )
    return matrix.select("cohort_month", "new_users", F.inline(cells)).withColumn(
        "band", band(F.col("retention_pct"), RETENTION_BANDS, LOWEST_BAND)
    )


def sheet_quality(steps: DataFrame, labels: Mapping[str, str] = STEP_LABELS) -> DataFrame:
    return steps.withColumn("step_label", label_of(F.col("step"), labels)).select(*QUALITY_HEADERS)


def retention_headers(config: AnalysisConfig) -> dict[str, str]:
    cells = {f"m{k}_retention_pct": RETENTION_CELL_HEADER.format(offset=k) for k in config.matrix_offsets}
    return {**RETENTION_HEADERS, **cells}


def with_headers(sheet: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """A feed under its display headers."""
    return sheet.withColumnsRenamed(dict(headers))


def metric_cards(cleaned: DataFrame, headline: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The four headline cards: label, value and note, values as display text."""
    month = month_bounds(config.months.peak)[0].month
    slug = month_slug(config.months.peak)
    peak_revenue, order_share, revenue_share = (
        F.col(f"{slug}_{name}") for name in ("avg_daily_revenue", "guest_order_share_pct", "guest_revenue_share_pct")
    )
    m1 = F.col("average_m1_retention_pct")
    order_share = percent_text(order_share)
    values = [
        thousands(F.col("revenue"), 2),
        thousands(peak_revenue, 2),
        percent_text(revenue_share),
        percent_text(m1),
    ]
    cards = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(label.format(month=month)).alias("label"),
            value.alias("value"),
            fill(note, share=order_share).alias("note"),
        )
        for position, ((label, note), value) in enumerate(zip(CARDS, values, strict=True), start=1)
    ]
    return side_by_side(cleaned.select("revenue"), headline).select(F.inline(F.array(*cards)))


def consistency_sentence(note: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The outlier effect of the base month in words, one row."""
    first, _ = month_bounds(config.months.base)
    without, with_rule = (thousands(F.col(name), 2) for name in note.columns[:2])
    text = fill(
        CONSISTENCY_SENTENCE,
        quantity=F.col("outlier_quantity").cast("string"),
        year=F.lit(str(first.year)),
        month=F.lit(str(first.month)),
        with_rule=with_rule,
        without_rule=without,
    )
    return note.select(text.alias("note"))
