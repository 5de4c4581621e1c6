"""The co-partitioned layout: the same lines, joined without a shuffle."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest
from conftest import TESTDATA

from tillwise.operators import facts, kpi
from tillwise.operators.facts import FACT_INPUT
from tillwise.registry import STAR_CONFIG, queries
from tillwise.sources import Tables, layout, star_lines

SF = f"{TESTDATA}/sf0.01"
BUCKETS = 6


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "star")
    layout.write_star_layout(spark, lambda name: spark.read.parquet(f"{SF}/{name}.parquet"), path, BUCKETS)
    layout.close_star_layout(spark, path)
    return path


def below(plan: str, node: str) -> list[str]:
    """The lines of a plan under its first line that holds the node."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if node in line)
    depth = lines[at].index(re.search(r"\w", lines[at])[0])
    under = []
    for line in lines[at + 1 :]:
        found = re.search(r"\w", line)
        if not found or found.start() <= depth:
            break
        under.append(line)
    return under


def daily(lines):
    return kpi.daily_stats(facts.line_facts(lines, STAR_CONFIG.rules), STAR_CONFIG.window)


def test_the_order_join_shuffles_nothing(spark, path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = daily(layout.layout_lines(spark, path, FACT_INPUT))._jdf.queryExecution().executedPlan().toString()
        plain = daily(star_lines(spark, SF, FACT_INPUT))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    under = below(bucketed, "SortMergeJoin [l_orderkey")
    assert under and not [line for line in under if "Exchange" in line]
    assert sum("FileScan" in line and f"SelectedBucketsCount: {BUCKETS}" in line for line in under) == 2
    assert sum("Exchange" in line for line in below(plain, "SortMergeJoin [l_orderkey")) == 2
    # Filters and columns still reach both scans.
    assert "PushedFilters: [IsNotNull(o_orderdate)" in bucketed and "l_comment" not in bucketed


def test_the_layout_gives_the_same_lines(spark, path):
    got, wanted = layout.layout_lines(spark, path), star_lines(spark, SF)
    assert got.schema == wanted.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert sorted(map(str, daily(got).collect())) == sorted(map(str, daily(wanted).collect()))


def test_one_file_per_bucket_and_one_bucket_per_key(path):
    for name, key in layout.BUCKETED.items():
        files = [p.name for p in Path(path, f"{name}.by.{key}.{BUCKETS}").glob("*.parquet")]
        assert len(files) == BUCKETS and len({re.search(r"_(\d{5})\.", f)[1] for f in files}) == BUCKETS


def test_a_layout_is_written_once_and_goes_with_its_owner(spark, monkeypatch):
    known = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("tillwise_")}
    before, made = known(), []
    write = layout.write_star_layout
    monkeypatch.setattr(layout, "write_star_layout", lambda *a: made.append(a[2]) or write(*a))
    with Tables(spark):
        assert queries()["bucketed_scan"](spark, f"{TESTDATA}/sf0.001").count() == 6000
        assert queries()["bucketed_daily_stats"](spark, f"{TESTDATA}/sf0.001").count() == STAR_CONFIG.window.days
        assert len(made) == 1 and Path(made[0].removeprefix("file://")).exists()
        assert len(known() - before) == 2
    assert not Path(made[0].removeprefix("file://")).exists()
    assert known() == before


def test_bucket_counts_follow_the_size():
    assert [layout.bucket_count(n) for n in (0, 1, 2**27, 2**27 + 1, 10**14)] == [1, 1, 1, 2, 745_059]


def test_buckets_of_a_query_fit_into_a_tasks_memory(spark, monkeypatch):
    """A bucket is sorted whole: tables of 512 MB in Parquet go to 32 buckets, not to four."""
    module, asked = sys.modules["tillwise.registry.queries"], []
    monkeypatch.setattr(module, "fingerprint", lambda *_: (("made-up.parquet", 2**29, 0),))
    write = layout.write_star_layout
    monkeypatch.setattr(layout, "write_star_layout", lambda *a: asked.append(a[3]) or write(*a[:3], 2))
    with Tables(spark):
        assert queries()["bucketed_scan"](spark, f"{TESTDATA}/sf0.001").count() == 6000
    assert asked == [32]


def test_lines_with_countries_leave_the_bucketed_lines_in_place(spark, path):
    """Countries come with the orders; the bucketed lines are not shuffled by order key for them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.layout_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(o_orderkey" in plan
    assert "c_custkey" in "".join(below(plan, "SortMergeJoin [l_orderkey"))


def test_hot_orders_and_orders_without_lines(spark, tmp_path):
    """A third of the lines on one order, and an order key that no order has."""
    spark.sql("SELECT IF(id % 3 = 0, 1L, id) AS l_orderkey, 1L AS l_partkey, CAST(id % 7 AS INT) AS l_linenumber, 2.0D AS l_quantity, 0.1D AS l_discount, 0.1D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus FROM range(1, 3001)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 50 AS o_custkey, TIMESTAMP_NTZ'1999-01-01 10:00:00' AS o_orderdate FROM range(1, 2500)").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("part", "customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    target = f"{tmp_path}/star"
    layout.write_star_layout(spark, lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"), target, 4)
    got, wanted = (sorted(map(str, daily(lines).collect())) for lines in (layout.layout_lines(spark, target), star_lines(spark, str(tmp_path))))
    assert got == wanted
    layout.close_star_layout(spark, target)
