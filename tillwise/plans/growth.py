"""The full report over one line table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import sinks
from tillwise.config import AnalysisConfig
from tillwise.functions import day_range
from tillwise.operators import cohort, documents, facts, guest, kpi, profile, quality
from tillwise.operators.observed import observed
from tillwise.operators.rows import settled
from tillwise.sources.shared import staged


@dataclass(frozen=True)
class GrowthReport:
    """Results over one ledger; the properties derive from the fields."""

    config: AnalysisConfig
    source_file: str
    raw_profile: DataFrame
    clean_profile: DataFrame
    quality_records: DataFrame
    consistency_note: DataFrame
    monthly_kpi: DataFrame
    cohort_retention_long: DataFrame
    guest_metrics: DataFrame

    @property
    def quality_steps(self) -> DataFrame:
        return self.quality_records.select(F.inline("data_quality"))

    @property
    def cohort_retention_matrix(self) -> DataFrame:
        return cohort.cohort_matrix(self.cohort_retention_long, self.config)

    @property
    def insights(self) -> DataFrame:
        return profile.insights(self.monthly_kpi, self.cohort_retention_matrix, self.guest_metrics, self.config)

    @property
    def summary(self) -> DataFrame:
        return documents.summary_document(
            self.raw_profile,
            self.clean_profile,
            self.quality_records,
            self.consistency_note,
            self.insights,
            self.source_file,
        )

    @property
    def dashboard(self) -> DataFrame:
        return documents.dashboard_bundle(
            self.summary, self.quality_records, self.monthly_kpi, self.cohort_retention_matrix, self.guest_metrics
        )

    def write(self, folder: str) -> dict[str, DataFrame]:
        """The five result tables as CSV and the two documents as JSON, published as one: a failure leaves the old report whole.

        Returns the output check of each table, by its name, as ``quality.output_check`` gives it; the jobs that write the tables
        gather them.
        """
        tables = {
            "data_quality_steps": (self.quality_steps, []),
            "monthly_kpi": (self.monthly_kpi, ["order_month"]),
            "cohort_retention_long": (self.cohort_retention_long, ["cohort_month", "month_diff"]),
            "cohort_retention_matrix": (self.cohort_retention_matrix, ["cohort_month"]),
            "guest_metrics": (self.guest_metrics, ["order_month"]),
        }
        with sinks.publication(self.monthly_kpi.sparkSession, folder) as aside:
            checks = {name: sinks.write_csv(frame, f"{aside}/{name}.csv", order_by) for name, (frame, order_by) in tables.items()}
            sinks.write_json(self.dashboard, f"{aside}/dashboard_data.json")
            sinks.write_json(self.summary, f"{aside}/analysis_summary.json")
        return checks


def growth_report(lines: DataFrame, config: AnalysisConfig, source_file: str = "") -> GrowthReport:
    """Every result from one read of the lines.

    Their ledger is staged, every result is computed from it as a small local frame, and the ledger is
    deleted again. The cleaning funnel, the size and the period of the lines are gathered while the ledger is written.
    The jobs run here, not when the results are read.
    """
    ledger, totals = observed(facts.order_ledger(lines, config.rules), facts.ledger_totals(config.rules))
    with staged(ledger, "order_ledger") as written:
        return settled_report(written, config, source_file, totals())


def settled_report(ledger: DataFrame, config: AnalysisConfig, source_file: str = "", totals: DataFrame | None = None) -> GrowthReport:
    """The results on a ledger that is there already, computed here as small local frames.

    ``totals`` are the ledger's totals, if they are known already.
    """
    if totals is None:
        totals = settled({"totals": ledger.agg(*facts.ledger_totals(config.rules))})["totals"]
    done = settled(results_of_ledger(ledger, totals, config))
    profiles = done.pop("profiles")
    return GrowthReport(
        config=config,
        source_file=source_file,
        raw_profile=profiles.select("raw_profile.*"),
        clean_profile=profiles.select("clean_profile.*"),
        quality_records=quality.quality_records(totals, config.rules),
        **done,
    )


def results_of_ledger(ledger: DataFrame, totals: DataFrame, config: AnalysisConfig) -> dict[str, DataFrame]:
    """The results that need the ledger's rows, one job each; nothing runs yet."""
    rules, base = config.rules, config.window.month(config.months.base)
    clean = facts.ledger_facts(ledger, rules)
    sensitivity = quality.outlier_sensitivity(quality.revenue_by_rule_of_ledger(ledger), base)
    return {
        "profiles": profile.profiles_of_ledger(ledger, totals, rules),
        "consistency_note": quality.consistency_note(sensitivity, quality.costliest_outlier_of_ledger(ledger, rules, base), config),
        "monthly_kpi": kpi.add_mom(kpi.monthly_kpi(kpi.daily_stats(clean, config.window))),
        "cohort_retention_long": cohort.cohort_retention(clean, config),
        "guest_metrics": guest.guest_metrics(guest.order_level(clean)),
    }


def headline(lines: DataFrame, config: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """The profile of the clean lines and the insights alone, from one read of the lines."""
    with staged(facts.compact(facts.line_facts(lines, config.rules)), "clean_facts") as clean:
        done = settled(
            {
                "profile": profile.profile_clean(clean),
                "kpi": kpi.monthly_kpi(kpi.daily_stats(clean, config.window)),
                "matrix": cohort.cohort_matrix(cohort.cohort_retention(clean, config), config),
                "guests": guest.guest_metrics(guest.order_level(clean)),
            }
        )
    return done["profile"], profile.insights(done["kpi"], done["matrix"], done["guests"], config)


def consistency(lines: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The consistency note alone, from one read of the base month's lines."""
    rules, base = config.rules, config.window.month(config.months.base)
    month = lines.filter(day_range(F.col("InvoiceDate"), base))
    with staged(facts.order_ledger(month, rules), "month_ledger") as ledger:
        sensitivity = quality.outlier_sensitivity(quality.revenue_by_rule_of_ledger(ledger), base)
        outlier = quality.costliest_outlier_of_ledger(ledger, rules, base)
        return settled({"note": quality.consistency_note(sensitivity, outlier, config)})["note"]
