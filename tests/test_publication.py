"""A report is published whole or not at all."""

from __future__ import annotations

from pathlib import Path

import pytest
from helpers import line, lines

from tillwise import sinks
from tillwise.config import AnalysisConfig
from tillwise.plans.growth import growth_report

RESULTS = {
    "data_quality_steps.csv", "monthly_kpi.csv", "cohort_retention_long.csv", "cohort_retention_matrix.csv", "guest_metrics.csv",
    "dashboard_data.json", "analysis_summary.json",
}


def content(folder: Path) -> dict[str, str]:
    """Texts of all parts by result; what lies beside the folder must be nothing."""
    assert [p.name for p in folder.parent.iterdir()] == ([folder.name] if folder.exists() else [])
    return {p.parent.name: p.read_text() for p in folder.rglob("part-*")}


@pytest.fixture(scope="module")
def reports(spark):
    """Two reports that differ in every document."""
    old = growth_report(lines(spark, line("1"), line("2", customer=None)), AnalysisConfig(), "old")
    new = growth_report(lines(spark, line("1"), line("3", quantity=9, when="2011-01-05 10:00:00")), AnalysisConfig(), "new")
    return old, new


def test_a_new_report_takes_the_place_of_the_old_one(reports, tmp_path):
    old, new = reports
    folder = tmp_path / "results"
    old.write(str(folder))
    first = content(folder)
    assert set(first) == RESULTS and '"old"' in first["analysis_summary.json"].replace(" ", "").replace(":", " ")
    (folder / "left_over.csv").mkdir()
    new.write(f"{folder}/")
    second = content(folder)
    assert set(second) == RESULTS and first["monthly_kpi.csv"] != second["monthly_kpi.csv"] and not (folder / "left_over.csv").exists()


@pytest.mark.parametrize("number", [1, 5, 7])
def test_a_failing_write_leaves_the_old_report_whole(spark, reports, tmp_path, monkeypatch, number):
    old, new = reports
    folder = tmp_path / "results"
    old.write(str(folder))
    before, done = content(folder), []

    def failing(write):
        def run(*args):
            done.append(1)
            if len(done) == number:
                raise OSError("disk is full")
            write(*args)
        return run

    monkeypatch.setattr(sinks, "write_csv", failing(sinks.write_csv))
    monkeypatch.setattr(sinks, "write_json", failing(sinks.write_json))
    with pytest.raises(OSError, match="disk is full"):
        new.write(str(folder))
    assert len(done) == number and content(folder) == before


def test_a_failing_rename_brings_the_old_report_back(spark, tmp_path, monkeypatch):
    folder = tmp_path / "results"
    with sinks.publication(spark, str(folder)) as aside:
        spark.range(1).write.parquet(f"{aside}/one")
    rename, calls = sinks._rename, []

    def second_fails(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("no rename")
        rename(*args)

    monkeypatch.setattr(sinks, "_rename", second_fails)
    with pytest.raises(OSError, match="no rename"), sinks.publication(spark, str(folder)) as aside:
        spark.range(2).write.parquet(f"{aside}/two")
    assert len(calls) == 3 and [p.name for p in tmp_path.iterdir()] == ["results"] and (folder / "one").exists()


def test_a_lost_driver_is_made_good(spark, tmp_path):
    """Between the renames there is no target; what the driver had moved aside comes back, and half written results go."""
    folder, mark = tmp_path / "results", "0" * 32
    (tmp_path / f"results.before-{mark}" / "kept").mkdir(parents=True)
    (tmp_path / f"results.writing-{mark}" / "half").mkdir(parents=True)
    (tmp_path / "results.other").mkdir()
    sinks.recover(spark, str(folder))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["results", "results.other"] and (folder / "kept").exists()
    # After the second rename only the old results are left over.
    (tmp_path / f"results.before-{mark}").mkdir()
    sinks.recover(spark, str(folder))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["results", "results.other"]
    sinks.recover(spark, str(tmp_path / "none" / "results"))
