"""Relations that must hold between the results of one report, at every size."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tillwise.operators.facts import FACT_INPUT
from tillwise.plans.growth import growth_report
from tillwise.registry import STAR_CONFIG
from tillwise.sources import star_lines


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_results_fit_together(spark, sf):
    lines = star_lines(spark, f"{TESTDATA}/{sf}", FACT_INPUT)
    report = growth_report(lines, STAR_CONFIG, "lineitem")
    clean = report.clean_profile.first()
    steps = report.quality_steps.collect()
    kpi = report.monthly_kpi.orderBy("order_month").collect()
    long = report.cohort_retention_long.collect()
    matrix = report.cohort_retention_matrix.collect()
    guests = report.guest_metrics.collect()

    assert report.raw_profile.first()["raw_rows"] == steps[0]["rows_remaining"] == lines.count()
    assert steps[-1]["rows_remaining"] == clean["rows"]
    for before, after in zip(steps, steps[1:], strict=False):
        assert before["rows_remaining"] - after["rows_remaining"] == after["rows_removed_from_previous"] >= 0

    # All guests together are one more customer; no invoice here has lines in two months.
    assert sum(r["new_users"] for r in matrix) + 1 == clean["customers_including_guest_key"]
    assert sum(r["total_orders"] for r in guests) == clean["unique_invoices"]

    for row in long:
        assert row["retention_rate"] == pytest.approx(100 * row["retained_users"] / row["new_users"], abs=0.005001)
        assert 0 < row["retained_users"] <= row["new_users"]
        assert 0 <= row["month_diff"] <= 11
    cells = sum(value is not None for row in matrix for value in row[2:])
    assert cells == sum(row["month_diff"] > 0 for row in long)

    days = {r["order_month"]: 0 for r in kpi}
    for month in days:
        days[month] = STAR_CONFIG.window.month(month).days
    total = sum(r["avg_daily_revenue"] * days[r["order_month"]] for r in kpi)
    assert total == pytest.approx(clean["revenue"], abs=0.005 * sum(days.values()))
    for before, after in zip(kpi, kpi[1:], strict=False):
        if before["avg_daily_orders"]:
            change = 100 * (after["avg_daily_orders"] / before["avg_daily_orders"] - 1)
            assert after["orders_mom_pct"] == pytest.approx(change, abs=0.005001)
    assert report.monthly_kpi.agg(F.count("revenue_mom_pct")).first()[0] == len(kpi) - 1
