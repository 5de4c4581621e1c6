"""Metrics gathered while the ledger and the results are written."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from helpers import line, lines

from tillwise.config import AnalysisConfig
from tillwise.operators import facts, profile, quality
from tillwise.operators.observed import observed
from tillwise.plans.growth import growth_report, settled_report
from tillwise.registry.queries import STAR_CONFIG
from tillwise.sources.star import star_lines


def made(spark, kind):
    if kind == "star":
        return star_lines(spark, f"{TESTDATA}/sf0.001", facts.FACT_INPUT), STAR_CONFIG
    rows = [
        line("1"), line("1", quantity=74215), line("C2", quantity=-1), line(None, customer=None), line("3", customer=None, price=None),
        line("4", when=None), line("5", when="2011-02-03 04:05:06", customer=None),
    ]
    return lines(spark, *(rows if kind == "odd" else [])), AnalysisConfig()


@pytest.mark.parametrize("kind", ["star", "odd", "empty"])
def test_gathered_values_equal_computed_ones(spark, kind, tmp_path):
    """The profiles, the funnel and the output checks, against what jobs of their own say."""
    frame, config = made(spark, kind)
    report = growth_report(frame, config, kind)
    for got, wanted in (
        (report.raw_profile, profile.profile_raw(frame)),
        (report.clean_profile, profile.profile_clean(facts.line_facts(frame, config.rules))),
        (report.quality_records, quality.quality_records(quality.step_counts(frame, config.rules), config.rules)),
    ):
        assert got.collect() == wanted.collect()
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in wanted.schema]
    checks = report.write(str(tmp_path / "results"))
    tables = ["data_quality_steps", "monthly_kpi", "cohort_retention_long", "cohort_retention_matrix", "guest_metrics"]
    names = ["quality_steps", *tables[1:]]
    assert list(checks) == tables
    for table, name in zip(tables, names, strict=True):
        assert checks[table].collect() == quality.output_check(getattr(report, name)).collect()
    ledger = facts.order_ledger(frame, config.rules)
    assert settled_report(ledger, config, kind).summary.collect() == report.summary.collect()


def test_observing_takes_no_job(spark, tmp_path):
    """Writing an observed frame runs the jobs of writing it, and its metrics none."""
    frame = lines(spark, line("1"), line("2", customer=None)).select("InvoiceNo", "CustomerID", "Quantity")
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, run):
        spark.sparkContext.setJobGroup(group, group)
        try:
            found = run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group)), found

    plain, _ = jobs("plain", lambda: frame.write.parquet(str(tmp_path / "plain")))
    watched, gathered = observed(frame, quality.output_measures(frame.schema))
    writing, _ = jobs("watched", lambda: watched.write.parquet(str(tmp_path / "watched")))
    asking, row = jobs("asking", gathered)
    assert writing == plain > 0 and asking == 0
    assert quality.output_check_rows(row, frame.schema).collect() == quality.output_check(frame).collect()
