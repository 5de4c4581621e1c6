"""Every analysis as a query over whole star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise import functions as fn
from tillwise import sinks
from tillwise.config import AnalysisConfig, CleaningRules, DayWindow, InsightMonths
from tillwise.operators import calendar, cleaning, cohort, distinct, documents, facts, followups, guest, kpi, profile, quality
from tillwise.operators import sheets
from tillwise.operators.activity import MonthRange
from tillwise.operators.facts import FACT_INPUT
from tillwise.plans import sql_reports
from tillwise.plans.daily import LedgerStore
from tillwise.plans.growth import GrowthReport, consistency, growth_report, headline
from tillwise.sources import (
    LINE_COLUMNS,
    Tables,
    current,
    fingerprint,
    layout,
    lines_of_csv_text,
    read_table,
    shared_path,
    staged,
    star_lines,
    star_paths,
    written,
)

Query = Callable[[SparkSession, str], DataFrame]

# The star tables span 1995-01-01 to 2001-08-01 and hold quantities up to 50.
STAR_CONFIG = AnalysisConfig(
    rules=CleaningRules(outlier_quantities=(49, 50)),
    window=DayWindow(date(1995, 1, 1), date(2001, 8, 1)),
    months=InsightMonths(base="2000-01", peak="2000-11", last="2001-08", cohort="1995-01", cohort_offset=11),
)
RULES = STAR_CONFIG.rules
BASE = STAR_CONFIG.window.month(STAR_CONFIG.months.base)
PEAK = STAR_CONFIG.window.month(STAR_CONFIG.months.peak)
TESTED = ["InvoiceNo", "StockCode", "Quantity", "UnitPrice"]
GUEST_INPUT = [*FACT_INPUT, "Country"]
CLEAN_DATED = ["InvoiceNo", "StockCode", "Quantity", "UnitPrice", "InvoiceDate"]


def portable(frame: DataFrame) -> DataFrame:
    """Exact decimals as DOUBLE, days and timestamps as text: types that all clients read alike."""
    columns: list[Column] = []
    for field in frame.schema:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampNTZType):
            value = value.cast("string")
        columns.append(value.alias(field.name))
    return frame.select(*columns)


def _lines(build: Callable[[DataFrame], DataFrame], columns: list[str]) -> Query:
    """A query on the line table, of which it reads the given columns."""
    return lambda spark, sf_dir: portable(build(star_lines(spark, sf_dir, columns)))


def _facts(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on the clean lines as facts."""
    return _lines(lambda lines: build(facts.line_facts(lines, RULES)), FACT_INPUT)


def _bucketed(build: Callable[[DataFrame], DataFrame], columns: list[str]) -> Query:
    """A query on the line table over a co-partitioned layout, which is written once for all queries of a session on the same files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = fingerprint(spark, *star_paths(sf_dir))

        def write(path: str) -> str:
            buckets = layout.bucket_count(sum(size for _, size, _ in files), layout.BUCKET_BYTES)
            layout.write_star_layout(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), path, buckets)
            return path

        path = current(spark).made((files, "layout"), "star_layout", write, lambda path: layout.close_star_layout(spark, path))
        return portable(build(layout.layout_lines(spark, path, columns)))

    return run


def _bitmaps(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on the bitmaps of the clean lines, which are staged once for all queries of a session on the same files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def state() -> DataFrame:
            return distinct.distinct_state(facts.line_facts(star_lines(spark, sf_dir, FACT_INPUT), RULES))

        key = (fingerprint(spark, *star_paths(sf_dir)), "distinct_state")
        return portable(build(current(spark).once(key, "distinct_state", state)))

    return run


def _report(build: Callable[[GrowthReport], DataFrame]) -> Query:
    """A query on several results, all from one read of the lines."""
    return lambda spark, sf_dir: portable(
        build(growth_report(star_lines(spark, sf_dir, FACT_INPUT), STAR_CONFIG, source_file="lineitem"))
    )


def _merged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary document from a ledger that has taken in all lines in two merges, the last month in both."""
    lines = star_lines(spark, sf_dir, FACT_INPUT)
    last_month = F.lit(f"{STAR_CONFIG.window.last_month}-01").cast("timestamp_ntz")
    with Tables(spark):
        store = LedgerStore(spark, shared_path(spark, "ledger"), RULES)
        store.merge(lines)
        store.merge(lines.filter(F.col("InvoiceDate") >= last_month))
        return portable(documents.document_values(store.report(STAR_CONFIG, source_file="lineitem").summary))


def _monthly(clean: DataFrame) -> DataFrame:
    return kpi.monthly_kpi(kpi.daily_stats(clean, STAR_CONFIG.window))


def _monthly_mom(clean: DataFrame) -> DataFrame:
    return kpi.add_mom(_monthly(clean))


def _retention(clean: DataFrame) -> DataFrame:
    return cohort.cohort_retention(clean, STAR_CONFIG, MonthRange.of(STAR_CONFIG.window))


def _matrix(clean: DataFrame) -> DataFrame:
    return cohort.cohort_matrix(_retention(clean), STAR_CONFIG)


def _guests(clean: DataFrame) -> DataFrame:
    return guest.guest_metrics(guest.order_level(clean))


def _funnel(lines: DataFrame) -> DataFrame:
    return quality.quality_steps(quality.step_counts(lines, RULES), RULES)


def _sensitivity(lines: DataFrame) -> DataFrame:
    return quality.outlier_sensitivity(quality.revenue_by_rule(lines, RULES, BASE), BASE)


def _consistency(lines: DataFrame) -> DataFrame:
    return consistency(lines, STAR_CONFIG)


def _last_day() -> Column:
    return F.lit(STAR_CONFIG.window.end)


def _scan_csv(lines: DataFrame) -> DataFrame:
    """The lines as CSV records, parsed by the rules of the CSV reader."""
    text = F.to_csv(F.struct(*LINE_COLUMNS), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"'})
    return lines_of_csv_text(lines.select(text.alias("record")), "record")


def _scan_table(lines: DataFrame) -> DataFrame:
    """The clean lines of a view, read by its name."""
    name = f"lines_{uuid.uuid4().hex}"
    lines.createOrReplaceTempView(name)
    clean = cleaning.clean(read_table(lines.sparkSession, name), RULES)
    lines.sparkSession.catalog.dropTempView(name)
    return clean.select("InvoiceNo", "InvoiceDate", "Quantity", "CustomerID")


def _sink_csv(report: GrowthReport) -> DataFrame:
    """The monthly KPI, written as CSV and read back."""
    spark = report.monthly_kpi.sparkSession
    path = shared_path(spark, "monthly_kpi_csv")
    sinks.write_csv(report.monthly_kpi, path, ["order_month"])
    return spark.read.option("header", True).schema(report.monthly_kpi.schema).csv(path)


def _written_check(report: GrowthReport) -> DataFrame:
    """The output check of the retention matrix, gathered while the report is published."""
    with Tables(report.monthly_kpi.sparkSession) as tables:
        checks = report.write(shared_path(tables.spark, "results"))
        return checks["cohort_retention_matrix"]


def _sink_json(report: GrowthReport) -> DataFrame:
    """The dashboard document, written as JSON, read back and laid out as values."""
    spark = report.dashboard.sparkSession
    path = shared_path(spark, "dashboard_json")
    sinks.write_json(report.dashboard, path)
    return documents.document_values(documents.read_document(spark, path, report.dashboard.schema))


def _scalars(lines: DataFrame) -> DataFrame:
    """Every scalar function of the analyses on every line."""
    day, code = F.to_date("InvoiceDate"), F.col("StockCode")
    ts_text = F.col("InvoiceDate").cast("string")
    start = F.lit(STAR_CONFIG.window.start)
    revenue, price = cleaning.line_revenue(), F.col("UnitPrice")
    return lines.select(
        "InvoiceNo",
        F.col("InvoiceNo").startswith("C").alias("is_cancelled"),
        F.length(code).alias("code_length"),
        F.col("CustomerID").cast("string").alias("id_text"),
        F.col("Quantity").cast("double").alias("quantity_double"),
        cleaning.customer_key().alias("customer_key"),
        F.col("CustomerID").isNull().alias("is_anonymous"),
        F.when(F.col("Quantity") > 25, "large").otherwise("small").alias("size"),
        F.to_timestamp_ntz(ts_text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("parsed_ts"),
        day.alias("order_date"),
        fn.month_text(day).alias("order_month"),
        F.trunc(day, "month").alias("month_start"),
        fn.month_diff(day, start).alias("month_diff"),
        F.date_diff(day, start).alias("day_diff"),
        F.date_add(day, 7).alias("week_later"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.size(F.sequence(F.trunc(day, "month"), day)).alias("days_into_month"),
        fn.round2(fn.ratio(price, F.col("Quantity"))).alias("price_per_unit"),
        fn.ratio(price, F.lit(0)).alias("safe_zero"),
        fn.pct(F.col("Quantity"), F.lit(50)).alias("quantity_pct"),
        fn.thousands(revenue, 2).alias("revenue_text"),
        F.concat(F.lit("line of "), F.col("InvoiceNo"), F.lit(": "), code).alias("sentence"),
        fn.band(F.col("Quantity").cast("double"), sheets.RETENTION_BANDS, sheets.LOWEST_BAND).alias("band"),
        fn.label_of(code, {"POST": "postage"}).alias("code_label"),
        F.to_json(F.struct("InvoiceNo", "Quantity"), {"ignoreNullFields": "false"}).alias("record"),
    )


def _summary_values(report: GrowthReport) -> DataFrame:
    """The summary document with its sections laid out as columns."""
    return report.summary.select(
        "dataset.*", "cleaned.*", F.size("data_quality").alias("steps"), "consistency_note.*", "insights.*"
    )


def _dashboard_tables(report: GrowthReport) -> DataFrame:
    """How many records each table of the dashboard bundle holds."""
    names = ["data_quality", "monthly_kpi", "cohort_retention_matrix", "guest_metrics"]
    return report.dashboard.select(*[F.size(name).alias(f"{name}_records") for name in names])


def _dashboard_table(name: str) -> Query:
    """One table of the dashboard bundle, as numbered rows again."""

    def build(report: GrowthReport) -> DataFrame:
        return report.dashboard.select(F.posexplode(name).alias("position", "record")).select("position", "record.*")

    return _report(build)


def _insights(lines: DataFrame) -> DataFrame:
    return headline(lines, STAR_CONFIG)[1]


def _cards(lines: DataFrame) -> DataFrame:
    return sheets.metric_cards(*headline(lines, STAR_CONFIG), STAR_CONFIG)


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The high-value guest orders, staged once for all queries of a session on the same files.

    Their quantile reads the guest orders twice before the leads do, so these are staged too, until the leads are written.
    """

    def write(path: str) -> DataFrame:
        orders = followups.guest_orders(star_lines(spark, sf_dir, GUEST_INPUT), RULES)
        with staged(orders, "guest_orders") as known:
            return written(followups.high_value_guests(known), path)

    return current(spark).made((fingerprint(spark, *star_paths(sf_dir)), "guest_leads"), "guest_leads", write)


def _guest_leads(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on the high-value guest orders."""
    return lambda spark, sf_dir: portable(build(_leads(spark, sf_dir)))


def _lead_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star_lines(spark, sf_dir, FACT_INPUT)
    return portable(followups.guest_lead_products(lines, RULES, _leads(spark, sf_dir)))


def _last_word() -> Column:
    return F.substring_index("Description", " ", -1)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        # sources
        "scan_retail": _lines(lambda lines: lines, LINE_COLUMNS),
        "scan_csv": _lines(_scan_csv, LINE_COLUMNS),
        "scan_table": _lines(_scan_table, LINE_COLUMNS),
        # the same from a co-partitioned layout
        "bucketed_scan": _bucketed(lambda lines: lines, LINE_COLUMNS),
        "bucketed_daily_stats": _bucketed(
            lambda lines: kpi.daily_stats(facts.line_facts(lines, RULES), STAR_CONFIG.window), FACT_INPUT
        ),
        # the same from one table of bitmaps
        "bitmap_daily_stats": _bitmaps(lambda state: distinct.daily_stats(state, STAR_CONFIG.window)),
        "bitmap_profile_clean": _bitmaps(distinct.profile_clean),
        # cleaning
        "clean_lines": _lines(lambda lines: cleaning.clean(lines, RULES), LINE_COLUMNS),
        "enriched_lines": _lines(lambda lines: cleaning.enrich(cleaning.clean(lines, RULES)), LINE_COLUMNS),
        "member_lines": _lines(
            lambda lines: cleaning.member_lines(cleaning.clean(lines, RULES)).select(
                "customer_id", "InvoiceNo", "InvoiceDate"
            ),
            FACT_INPUT,
        ),
        "data_quality_steps": _lines(_funnel, TESTED),
        "union_steps": _lines(lambda lines: quality.step_rows(quality.step_counts(lines, RULES), RULES), TESTED),
        "quality_steps_by_lag": _lines(
            lambda lines: quality.steps_by_lag(quality.step_rows(quality.step_counts(lines, RULES), RULES)), TESTED
        ),
        # growth
        "calendar_days": _lines(calendar.observed_calendar, ["InvoiceDate"]),
        "daily_stats": _facts(lambda clean: kpi.daily_stats(clean, STAR_CONFIG.window)),
        "monthly_kpi": _facts(_monthly),
        "monthly_kpi_mom": _facts(_monthly_mom),
        # retention
        "first_orders": _facts(cohort.first_orders),
        "join_first_orders": _facts(cohort.join_first_orders),
        "orders_with_cohort": _facts(lambda clean: cohort.orders_with_cohort(clean, MonthRange.of(STAR_CONFIG.window))),
        "cohort_sizes": _facts(lambda clean: cohort.cohort_sizes(cohort.first_orders(clean))),
        "cohort_retention_long": _facts(_retention),
        "cohort_retention_matrix": _facts(_matrix),
        # guests
        "order_level": _facts(guest.order_level),
        "guest_metrics": _facts(_guests),
        # quality and profiles
        "outlier_sensitivity": _lines(_sensitivity, CLEAN_DATED),
        "outlier_rows": _lines(lambda lines: quality.outlier_rows(lines, RULES), CLEAN_DATED),
        "profile_raw": _lines(profile.profile_raw, ["InvoiceNo", "InvoiceDate", "CustomerID"]),
        "profile_clean": _facts(profile.profile_clean),
        "consistency_note": _lines(_consistency, FACT_INPUT),
        "consistency_sentence": _lines(
            lambda lines: sheets.consistency_sentence(_consistency(lines), STAR_CONFIG), FACT_INPUT
        ),
        "output_check": _facts(lambda clean: quality.output_check(_monthly_mom(clean))),
        "output_check_matrix": _facts(lambda clean: quality.output_check(_matrix(clean))),
        "scalar_functions": _lines(_scalars, FACT_INPUT),
        # several results at once
        "order_ledger": _lines(lambda lines: facts.order_ledger(lines, RULES), FACT_INPUT),
        "insights": _lines(_insights, FACT_INPUT),
        "summary_document": _report(lambda report: documents.document_values(report.summary)),
        "merged_summary_document": _merged_summary,
        "summary_values": _report(_summary_values),
        "dashboard_bundle": _report(lambda report: documents.document_values(report.dashboard)),
        "sink_csv": _report(_sink_csv),
        "sink_json": _report(_sink_json),
        # gathered while the ledger and the results are written
        "written_profile_raw": _report(lambda report: report.raw_profile),
        "written_profile_clean": _report(lambda report: report.clean_profile),
        "written_quality_steps": _report(lambda report: report.quality_steps),
        "written_output_check": _report(_written_check),
        "dashboard_tables": _report(_dashboard_tables),
        "dashboard_quality": _dashboard_table("data_quality"),
        "dashboard_kpi": _dashboard_table("monthly_kpi"),
        "dashboard_matrix": _dashboard_table("cohort_retention_matrix"),
        "dashboard_guests": _dashboard_table("guest_metrics"),
        # report feeds
        "sheet_monthly": _facts(lambda clean: sheets.sheet_monthly(_monthly_mom(clean))),
        "sheet_guest": _facts(lambda clean: sheets.sheet_guest(_guests(clean))),
        "sheet_retention": _facts(lambda clean: sheets.sheet_retention(_matrix(clean), STAR_CONFIG)),
        "retention_bands": _facts(lambda clean: sheets.retention_bands(_matrix(clean), STAR_CONFIG)),
        "sheet_quality": _lines(lambda lines: sheets.sheet_quality(_funnel(lines)), TESTED),
        "metric_cards": _lines(_cards, FACT_INPUT),
        # the reports as SQL text
        "sql_funnel": _lines(lambda lines: sql_reports.run_sql(sql_reports.FUNNEL, lines, STAR_CONFIG), TESTED),
        "sql_monthly_kpi": _lines(
            lambda lines: sql_reports.run_sql(sql_reports.MONTHLY_KPI, lines, STAR_CONFIG), FACT_INPUT
        ),
        "sql_cohort_retention": _lines(
            lambda lines: sql_reports.run_sql(sql_reports.COHORT_RETENTION, lines, STAR_CONFIG), FACT_INPUT
        ),
        "sql_guest_metrics": _lines(
            lambda lines: sql_reports.run_sql(sql_reports.GUEST_METRICS, lines, STAR_CONFIG), FACT_INPUT
        ),
        # follow-up questions
        "ext_top_sku": _lines(lambda lines: followups.top_products(lines, RULES, PEAK), CLEAN_DATED),
        "ext_guest_leads": _guest_leads(lambda leads: leads),
        "ext_guest_by_country": _guest_leads(lambda leads: followups.guest_leads_by(leads, F.col("country"), "country")),
        "ext_guest_by_size": _guest_leads(
            lambda leads: followups.guest_leads_by(leads, followups.order_size_band(), "size_band")
        ),
        "ext_guest_by_product": _lead_products,
        "ext_repeat_vs_churn": _lines(lambda lines: followups.repeat_vs_one_time(lines, RULES, _last_day()), FACT_INPUT),
        "ext_recontact": _facts(
            lambda clean: followups.recontact_list(clean, _last_day())
        ),
        "ext_seasonality": _lines(
            lambda lines: followups.seasonality(lines, RULES, _last_word()), [*CLEAN_DATED, "Description"]
        ),
        "ext_country_kpi": _lines(lambda lines: followups.country_kpi(lines, RULES), [*FACT_INPUT, "Country"]),
        "ext_censoring_flags": _facts(lambda clean: followups.censoring_flags(_retention(clean), STAR_CONFIG)),
        "ext_weak_months": _facts(lambda clean: followups.weak_months(_monthly(clean))),
    }
    for key, step in {
        "filter_not_cancelled": "remove_cancel_invoice",
        "filter_code_length": "remove_short_stock_code",
        "filter_positive_quantity": "remove_non_positive_quantity",
        "filter_positive_price": "remove_non_positive_unit_price",
        "filter_outlier_quantity": "remove_quantity_outliers",
    }.items():
        out[key] = _lines(lambda lines, step=step: cleaning.apply_step(lines, RULES, step), TESTED)
    return out
