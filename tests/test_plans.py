"""Shapes of the physical plans, and results when a few keys hold a third of the lines."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tillwise.operators import cohort, facts, followups, guest, kpi, profile, quality
from tillwise.operators.facts import FACT_INPUT
from tillwise.plans import sql_reports
from tillwise.plans.growth import consistency, growth_report, headline
from tillwise.registry import STAR_CONFIG, queries
from tillwise.sources import shared_folder, star_lines

SF = f"{TESTDATA}/sf0.01"
RULES, WINDOW = STAR_CONFIG.rules, STAR_CONFIG.window


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The lines as a table of their own, as they would be stored."""
    path = str(tmp_path_factory.mktemp("lines") / "lines")
    star_lines(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the lines on one invoice, customer, day, product and country."""
    base = star_lines(spark, SF)
    hot = F.pmod(F.hash("InvoiceNo", "StockCode", "Quantity"), F.lit(3)) == 0
    fixed = {
        "InvoiceNo": F.lit("hot"),
        "StockCode": F.lit("SKUHOT"),
        "InvoiceDate": F.lit("1999-05-05 10:00:00").cast("timestamp_ntz"),
        "CustomerID": F.lit(99).cast("bigint"),
        "Country": F.lit("HOTLAND"),
    }
    return base.select(*[F.when(hot, fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else c for c in base.columns])


def test_no_python_and_no_nested_loops_anywhere(spark):
    for name, query in queries().items():
        plan = plan_of(query(spark, f"{TESTDATA}/sf0.001"))
        assert not re.search(r"Python|Pandas|Arrow|NestedLoop|Cartesian", plan), name


@pytest.mark.parametrize(
    ("build", "scans"),
    [
        (lambda f: kpi.add_mom(kpi.monthly_kpi(kpi.daily_stats(f, WINDOW))), 1),
        (lambda f: cohort.cohort_matrix(cohort.cohort_retention(f, STAR_CONFIG), STAR_CONFIG), 1),
        (lambda f: guest.guest_metrics(guest.order_level(f)), 1),
        (profile.profile_clean, 1),
    ],
)
def test_one_scan_of_the_lines(table, build, scans):
    plan = plan_of(build(facts.line_facts(table, RULES)))
    assert plan.count("FileScan") == scans
    assert "SortMergeJoin" not in plan


def test_ledger_and_funnel_scan_once(table):
    assert plan_of(facts.order_ledger(table, RULES)).count("FileScan") == 1
    assert plan_of(quality.step_counts(table, RULES)).count("FileScan") == 1


def test_filters_and_columns_reach_the_scan(table):
    plan = plan_of(cohort.cohort_retention(facts.line_facts(table, RULES), STAR_CONFIG))
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", plan).group(1)
    wanted = ("StringStartsWith(InvoiceNo,C)", "GreaterThan(Quantity,0)", "Not(In(Quantity", "IsNotNull(CustomerID)")
    for part in wanted:
        assert part in pushed.replace(" ", ""), (part, pushed)
    assert "Description" not in plan and "Country" not in plan

    plan = plan_of(kpi.daily_stats(facts.line_facts(table, RULES), WINDOW))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(InvoiceDate,1995-01-01", plan)

    month = WINDOW.month("2000-01")
    plan = plan_of(quality.outlier_sensitivity(quality.revenue_by_rule(table, RULES, month), month))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(InvoiceDate,2000-01-01", plan)
    assert "CustomerID" not in plan


def test_top_products_is_a_distributed_top_k(table):
    plan = plan_of(followups.top_products(table, RULES, WINDOW.month("2000-11")))
    assert "TakeOrderedAndProject" in plan


def test_lines_and_ledger_give_the_same_results(table):
    by_line = facts.line_facts(table, RULES)
    by_order = facts.ledger_facts(facts.order_ledger(table, RULES), RULES)
    _same_results(by_line, by_order)


def test_skewed_lines_and_ledger_give_the_same_results(skewed):
    by_line = facts.line_facts(skewed, RULES)
    by_order = facts.ledger_facts(facts.order_ledger(skewed, RULES), RULES)
    assert by_order.groupBy("InvoiceNo").count().agg(F.max("count")).first()[0] < 100
    _same_results(by_line, by_order)


def _same_results(one, other):
    for build in (
        lambda f: kpi.daily_stats(f, WINDOW),
        lambda f: cohort.cohort_retention(f, STAR_CONFIG),
        cohort.first_orders,
        guest.order_level,
        lambda f: guest.guest_metrics(guest.order_level(f)),
        profile.profile_clean,
    ):
        assert rows_of(build(one)) == rows_of(build(other))


def test_sql_text_and_operators_agree_on_skewed_lines(skewed):
    clean = facts.line_facts(skewed, RULES)
    pairs = [
        (sql_reports.FUNNEL, quality.step_rows(quality.step_counts(skewed, RULES), RULES)),
        (sql_reports.MONTHLY_KPI, kpi.monthly_kpi(kpi.daily_stats(clean, WINDOW))),
        (sql_reports.COHORT_RETENTION, cohort.cohort_retention(clean, STAR_CONFIG)),
        (sql_reports.GUEST_METRICS, guest.guest_metrics(guest.order_level(clean))),
    ]
    for text, frame in pairs:
        by_text = sql_reports.run_sql(text, skewed, STAR_CONFIG)
        assert rows_of(by_text.select(*frame.columns)) == rows_of(frame)


def test_follow_ups_on_skewed_lines(skewed):
    """Against plain Python over the collected clean lines."""
    clean = [r for r in facts.clean(skewed, RULES).collect()]
    by_customer, by_invoice = {}, {}
    for r in clean:
        by_invoice.setdefault(r["InvoiceNo"], []).append(r)
        if r["CustomerID"] is not None:
            by_customer.setdefault(r["CustomerID"], []).append(r)

    expected, last_day = {}, date(2000, 6, 30)
    for rows in by_customer.values():
        days = sorted({r["InvoiceDate"].date() for r in rows})
        gap = (days[1] - days[0]).days if len(days) > 1 else None
        for code in {r["StockCode"] for r in rows if r["InvoiceDate"].date() == days[0]}:
            counts = expected.setdefault(code, [0] * 6)
            seen = [(last_day - days[0]).days >= n for n in (30, 60)]
            back = [s and gap is not None and gap <= n for s, n in zip(seen, (30, 60), strict=True)]
            for i, hit in enumerate((True, seen[0], back[0], seen[1], back[1], gap is None)):
                counts[i] += hit
    got = {r["StockCode"]: list(r)[1:7] for r in followups.repeat_vs_one_time(skewed, RULES, F.lit(last_day)).collect()}
    assert got == expected

    revenue = {
        invoice: sum(r["Quantity"] * r["UnitPrice"] for r in rows)
        for invoice, rows in by_invoice.items()
        if all(r["CustomerID"] is None for r in rows)
    }
    ordered = sorted(revenue.values())
    threshold = ordered[-(-9 * len(ordered) // 10) - 1]
    orders = followups.guest_orders(skewed, RULES)
    leads = {r["InvoiceNo"] for r in followups.high_value_guests(orders).collect()}
    assert leads == {invoice for invoice, value in revenue.items() if value >= threshold}


def test_report_reads_each_source_once(spark):
    """The ledger's plan scans every table once, and nothing that was staged for a report is left."""
    lines = star_lines(spark, f"{TESTDATA}/sf0.001", FACT_INPUT)
    plan = facts.order_ledger(lines, RULES)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 3
    folder = Path(shared_folder(spark))
    before = {p.name for p in folder.glob("*ledger*")} | {p.name for p in folder.glob("clean_facts*")}
    growth_report(lines, STAR_CONFIG)
    headline(lines, STAR_CONFIG)
    consistency(lines, STAR_CONFIG)
    assert {p.name for p in folder.glob("*ledger*")} | {p.name for p in folder.glob("clean_facts*")} == before


def test_first_orders_join_without_text_keys(spark):
    plan = queries()["join_first_orders"](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(customer_id", plan) and "hashpartitioning(CustomerID" in plan
def test_hot_keys_are_split_in_the_sort_merge_join(spark, tmp_path):
    """The order join with a third of the lines on one order, forced to the plan of a big cluster."""
    for name in ("orders", "part", "customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    source = spark.read.parquet(f"{SF}/lineitem.parquet")
    hot = F.pmod(F.hash("l_orderkey", "l_partkey"), F.lit(3)) == 0
    wide = source.withColumn("l_orderkey", F.when(hot, 77).otherwise(F.col("l_orderkey")))
    tenfold = wide.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy")
    tenfold.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        lines = star_lines(spark, str(tmp_path), FACT_INPUT)
        expected = rows_of(kpi.daily_stats(facts.line_facts(lines, RULES), WINDOW))
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = kpi.daily_stats(facts.line_facts(star_lines(spark, str(tmp_path), FACT_INPUT), RULES), WINDOW)
        assert rows_of(frame) == expected
        assert "SortMergeJoin(skew=true)" in plan_of(frame)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.session.timeZone": "America/Sao_Paulo"},
        {"spark.sql.session.timeZone": "Pacific/Apia"},
        {"spark.sql.ansi.enabled": "false"},
        {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"},
    ],
    ids=str,
)
def test_results_do_not_depend_on_the_session(spark, settings):
    names = [
        "scalar_functions",
        "monthly_kpi_mom",
        "cohort_retention_matrix",
        "guest_metrics",
        "profile_raw",
        "outlier_sensitivity",
        "ext_seasonality",
        "ext_recontact",
        "summary_values",
    ]
    sf = f"{TESTDATA}/sf0.001"
    expected = {name: rows_of(queries()[name](spark, sf)) for name in names}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for name in names:
            assert rows_of(queries()[name](spark, sf)) == expected[name], name
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
