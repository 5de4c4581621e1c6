"""The operators reproduce the published results from inputs rebuilt out of them."""

from __future__ import annotations

from datetime import date

import published as p
import pytest

from tillwise.config import AnalysisConfig, CleaningRules
from tillwise.operators import cohort, guest, kpi, profile, quality, sheets

CONFIG = AnalysisConfig()


def month_after(month: str, offset: int) -> date:
    year, number = map(int, month.split("-"))
    index = year * 12 + number - 1 + offset
    return date(index // 12, index % 12 + 1, 5)


@pytest.fixture(scope="module")
def kpi_frame(spark):
    columns = "order_month string, avg_daily_revenue double, avg_daily_customers double, avg_daily_orders double"
    return kpi.add_mom(spark.createDataFrame([r[:4] for r in p.table(p.MONTHLY_KPI)], columns))


@pytest.fixture(scope="module")
def member_facts(spark):
    """Members who return exactly as often as published."""
    rows, customer = [], 0
    for month, (size, *retained) in p.retained().items():
        for n in range(size):
            customer += 1
            rows.append((month_after(month, 0), customer))
            rows += [(month_after(month, k), customer) for k, r in enumerate(retained, start=1) if n < r]
    return spark.createDataFrame(rows, "order_date date, CustomerID bigint")


@pytest.fixture(scope="module")
def matrix(member_facts):
    return cohort.cohort_matrix(cohort.cohort_retention(member_facts, CONFIG), CONFIG).cache()


@pytest.fixture(scope="module")
def guests(spark):
    rows = [(r[0], r[1], r[2], float(r[3]), float(r[4]), float(r[5])) for r in p.table(p.GUEST_METRICS)]
    columns = (
        "order_month string, guest_orders bigint, total_orders bigint, guest_order_share_pct double,"
        " guest_revenue_share_pct double, guest_avg_revenue_per_order double"
    )
    return spark.createDataFrame(rows, columns)


def test_funnel(spark):
    rows = p.table(p.FUNNEL)
    counts = spark.createDataFrame([[r[1] for r in rows]], ", ".join(f"rows_{n} bigint" for n in range(6)))
    result = quality.quality_steps(counts, CleaningRules())
    assert result.columns == [
        "step",
        "description",
        "rows_remaining",
        "rows_removed_from_previous",
        "rows_remaining_pct",
    ]
    assert [(r[0], r[2], r[3], r[4]) for r in result.collect()] == rows
    by_lag = quality.steps_by_lag(quality.step_rows(counts, CleaningRules())).orderBy("step_order").collect()
    assert [tuple(r)[1:] for r in by_lag] == rows


def test_month_over_month(kpi_frame):
    changes = ["revenue_mom_pct", "customers_mom_pct", "orders_mom_pct"]
    assert kpi_frame.columns == ["order_month", *kpi.KPI_COLUMNS, *changes]
    assert [tuple(r) for r in kpi_frame.orderBy("order_month").collect()] == p.table(p.MONTHLY_KPI)


def test_cohort_sizes_and_long_retention(member_facts):
    firsts = cohort.first_orders(member_facts)
    sizes = {r["cohort_month"]: r["new_users"] for r in cohort.cohort_sizes(firsts).collect()}
    assert sizes == {cohort: counts[0] for cohort, counts in p.retained().items()}
    assert sum(sizes.values()) + 1 == p.CUSTOMERS_WITH_GUEST_KEY
    long = cohort.cohort_retention(member_facts, CONFIG)
    assert long.columns == ["cohort_month", "month_diff", "retained_users", "new_users", "retention_rate"]
    assert sorted(tuple(r) for r in long.collect()) == p.table(p.RETENTION)
    assert len(p.table(p.RETENTION)) == 90


def test_cohort_matrix(matrix):
    assert matrix.columns == ["cohort_month", "new_users", *[f"m{k}_retention_pct" for k in range(1, 12)]]
    assert [tuple(r) for r in matrix.orderBy("cohort_month").collect()] == p.table(p.MATRIX, width=13)


def test_guest_order_share(spark):
    rows = [
        (month, f"{month}-{n}", 10, n < guest_count)
        for month, guest_count, total, *_ in p.table(p.GUEST_METRICS)
        for n in range(total)
    ]
    assert len(rows) == p.CLEAN_INVOICES
    orders = spark.createDataFrame(rows, "order_month string, InvoiceNo string, order_revenue int, is_guest boolean")
    result = guest.guest_metrics(orders).orderBy("order_month").collect()
    assert [tuple(r)[:4] for r in result] == [r[:4] for r in p.table(p.GUEST_METRICS)]


def test_insights(kpi_frame, matrix, guests):
    assert profile.insights(kpi_frame, matrix, guests, CONFIG).first().asDict() == p.INSIGHTS


def test_cards(spark, kpi_frame, matrix, guests):
    cleaned = spark.createDataFrame([(p.CLEAN_REVENUE,)], "revenue double")
    cards = sheets.metric_cards(cleaned, profile.insights(kpi_frame, matrix, guests, CONFIG), CONFIG).collect()
    assert [tuple(r) for r in cards] == [
        (1, "정제 후 매출", "10,040,391.76", "전처리 기준 적용"),
        (2, "11월 일평균 매출", "48,592.52", "Q4 수요 피크"),
        (3, "11월 비회원 매출 비중", "21.65%", "주문 비중은 3.96%"),
        (4, "+1개월 리텐션", "20.45%", "초기 이탈 관리 필요"),
    ]


def test_consistency_sentence(spark):
    note = spark.createDataFrame(
        [(21677.66, 19187.86, "541431", 74215, 77183.6)],
        "without_rule double, with_rule double, outlier_invoice string, outlier_quantity int, outlier_revenue double",
    )
    text = sheets.consistency_sentence(note, CONFIG).first()[0]
    assert "Quantity 74215" in text and "2011년 1월" in text
    assert text.index("19,187.86") < text.index("21,677.66")


def test_retention_bands(matrix):
    bands = sheets.retention_bands(matrix, CONFIG).collect()
    assert len(bands) == 13 * 11
    by_cell = {(r["cohort_month"], r["month_diff"]): r["band"] for r in bands}
    assert by_cell["2010-12", 1] == "high"
    assert by_cell["2010-12", 2] == "good"
    assert by_cell["2011-02", 1] == "fair"
    assert by_cell["2011-03", 1] == "low"
    assert by_cell["2011-12", 1] is None


def test_sheet_headers(spark, kpi_frame, matrix, guests):
    monthly = sheets.with_headers(sheets.sheet_monthly(kpi_frame), sheets.MONTHLY_HEADERS)
    assert monthly.columns[:2] == ["거래월", "일평균 매출"] and len(monthly.columns) == 7
    retention = sheets.with_headers(sheets.sheet_retention(matrix, CONFIG), sheets.retention_headers(CONFIG))
    assert retention.columns[:3] == ["코호트", "신규 고객 수", "+1개월"] and retention.columns[-1] == "+11개월"
    assert sheets.sheet_guest(guests).columns[-2:] == ["guest_orders", "total_orders"]
    unknown = spark.createDataFrame([("other", "d", 1, 0, 1.0)], "step string, description string, rows_remaining int,"
                                    " rows_removed_from_previous int, rows_remaining_pct double")
    assert sheets.sheet_quality(unknown).first()["step_label"] == "other"
