"""Exact quantiles by distributed selection, and the guest leads that are built on them."""

from __future__ import annotations

import math
import random
from decimal import Decimal
from fractions import Fraction
from pathlib import Path

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tillwise.operators import followups, ranks
from tillwise.operators.ranks import exact_quantile, exact_quantiles
from tillwise.registry import oracle_sql, queries
from tillwise.sources import Tables, shared_folder

SF = f"{TESTDATA}/sf0.01"


def plain(values, q):
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(Fraction(str(q)) * len(values))) - 1]


def frame_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v decimal(14,4)").repartition(4)


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_quantiles_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "MOST_ROWS", most)
    dice = random.Random(1)
    spread = [Decimal(dice.randrange(10**9)) / 10_000 for _ in range(4000)]
    hot = [Decimal(7)] * 2000 + spread[:3000] + [None] * 50
    # With 100 as accuracy a bracket holds about 160 of the 4000 values, many more than 40.
    for values in (spread, hot, [Decimal(3)] * 100, [Decimal(1), None]):
        qs = [0.0, 0.07, 0.55, 0.9, 0.901, 1.0]
        found = exact_quantiles(frame_of(spark, values), "v", qs, accuracy=100)
        assert [f.value for f in found] == [plain(values, q) for q in qs]
        assert all(f.sorted_rows <= most for f in found)


def test_large_frames(spark):
    many = spark.range(1, 1_000_001).select((F.col("id") % 300_007).cast("decimal(12,2)").alias("v"))
    values = sorted(i % 300_007 for i in range(1, 1_000_001))
    found = exact_quantiles(many, "v", [0.55, 0.07, 0.001])
    assert [f.value for f in found] == [values[math.ceil(Fraction(str(q)) * 1_000_000) - 1] for q in (0.55, 0.07, 0.001)]
    # Three brackets of about 4 in 10,000 values over 8 ranges.
    assert max(f.sorted_rows for f in found) < 1000


def test_share_counts_as_written(spark):
    whole = spark.range(1, 101).select(F.col("id").cast("decimal(12,2)").alias("v"))
    assert exact_quantile(whole, "v", 0.07) == 7 and exact_quantile(whole, "v", 0.9) == 90
    assert exact_quantile(whole.limit(0), "v", 0.5) is None
    assert exact_quantile(whole.select(F.lit(None).cast("decimal(12,2)").alias("v")), "v", 0.5) is None


@pytest.mark.parametrize("q", [0.01, 0.07, 0.5, 0.55, 0.9, 1.0])
def test_exact_quantile(spark, q):
    values = [3.5] * 400 + [n * 1.25 for n in range(1, 601)] + [9e13]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(F.col("v").cast("decimal(24,4)"))
    rank = max(1, math.ceil(Fraction(str(q)) * len(values)))
    assert float(exact_quantile(frame, "v", q)) == sorted(values)[rank - 1]
    assert exact_quantile(frame.limit(0), "v", q) is None


@pytest.mark.parametrize("side", ["low", "high", "middle"])
def test_a_rank_outside_of_its_bracket_is_still_found(spark, monkeypatch, side):
    """Brackets that miss the rank, as if the approximation had failed."""
    monkeypatch.setattr(ranks, "MOST_ROWS", 30)
    values = [Decimal(i % 500) for i in range(3000)]
    wrong = {"low": [(Decimal(0), Decimal(3))], "high": [(Decimal(490), Decimal(499))], "middle": [(Decimal(2), Decimal(4)), (Decimal(480), Decimal(481))]}[side]
    monkeypatch.setattr(ranks, "_merged", lambda _: wrong)
    found = exact_quantiles(frame_of(spark, values), "v", [0.0, 0.07, 0.55, 1.0])
    assert [f.value for f in found] == [plain(values, q) for q in (0.0, 0.07, 0.55, 1.0)]
    assert all(f.sorted_rows <= 30 for f in found)


def test_selection_leaves_nothing(spark):
    with Tables(spark):
        before = set(Path(shared_folder(spark)).glob("*"))
        assert exact_quantile(frame_of(spark, [Decimal(i) for i in range(100)]), "v", 0.5) == 49
        assert set(Path(shared_folder(spark)).glob("*")) == before


def test_no_window_runs_over_all_values():
    text = Path(ranks.__file__).read_text() + Path(followups.__file__).read_text()
    assert "Window.orderBy(F.asc_nulls_first" not in text and text.count('Window.partitionBy("range")') == 1


def test_guest_orders_are_staged_once_for_four_queries(spark, monkeypatch):
    built = []
    plain_orders = followups.guest_orders
    monkeypatch.setattr(followups, "guest_orders", lambda *a: built.append(1) or plain_orders(*a))
    names = ["ext_guest_leads", "ext_guest_by_country", "ext_guest_by_size", "ext_guest_by_product"]
    folder = Path(shared_folder(spark))
    outside = set(folder.glob("*"))
    with Tables(spark):
        counts = [queries()[name](spark, SF).count() for name in names]
        assert built == [1] and len(set(folder.glob("*")) - outside) == 1
    assert all(counts) and set(folder.glob("*")) == outside
    with Tables(spark):
        assert queries()["ext_guest_leads"](spark, SF).count() == counts[0] and built == [1, 1]
        assert queries()["ext_guest_leads"](spark, f"{TESTDATA}/sf0.001").count() != counts[0] and built == [1, 1, 1]
    assert set(names) <= set(oracle_sql())
