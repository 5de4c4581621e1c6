"""Activity bits: against sets of months, beyond one word, and what they shuffle."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import pytest
from conftest import TESTDATA
from helpers import shuffled_rows
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig, DayWindow, InsightMonths
from tillwise.functions import month_index
from tillwise.operators import cohort, facts
from tillwise.operators.activity import WORD_MONTHS, MonthRange, cohort_counts, member_activity, member_offsets, observed_months
from tillwise.operators.facts import FACT_INPUT
from tillwise.registry import STAR_CONFIG
from tillwise.sources import star_lines

DDL = "order_date date, InvoiceNo string, CustomerID long, line_revenue decimal(14,4), line_count long"


def visits(spark, rows):
    return spark.createDataFrame([(day, "i", member, None, 1) for member, day in rows], DDL)


def months_of(rows):
    out = defaultdict(set)
    for member, day in rows:
        if member is not None and day is not None:
            out[member].add(day.year * 12 + day.month - 1)
    return out


def random_visits(seed, years):
    dice = random.Random(seed)
    rows = [(m, date(1990 + dice.randrange(years), dice.randrange(1, 13), 5)) for m in range(200) for _ in range(dice.randrange(1, 40))]
    rows += [(7, date(1990 + y, m, d)) for y in range(years) for m in (1, 12) for d in (1, 2, 3)] * 20
    return rows + [(None, date(1991, 1, 1)), (1000, None), (3, None), (5000, date(1990, 1, 1)), (5000, date(1990 + years - 1, 12, 31))]


@pytest.mark.parametrize("years", [2, 6, 21])
def test_bits_are_the_months(spark, years):
    """One word, two words and four words; a hot member, members over the whole range, null members and days."""
    rows = random_visits(years, years)
    frame, truth = visits(spark, rows).repartition(3), months_of(rows)
    months = observed_months(frame)
    assert (months.first, months.months, months.words) == (1990 * 12, years * 12, -(-years * 12 // WORD_MONTHS))
    offsets = defaultdict(set)
    for r in member_offsets(member_activity(frame, months), months).collect():
        offsets[r.CustomerID].add(r.cohort + r.month_diff)
        assert r.cohort == min(truth[r.CustomerID])
    assert offsets == truth
    most = 30
    counts = defaultdict(int)
    for of in truth.values():
        for m in of:
            if m - min(of) <= most:
                counts[min(of), m - min(of)] += 1
    got = {(r.cohort, r.month_diff): (r.retained_users, r.new_users) for r in cohort_counts(member_activity(frame, months), months, most).collect()}
    assert got == {key: (n, counts[key[0], 0]) for key, n in counts.items()}


def test_wider_ranges_give_the_same_and_narrower_ones_fail(spark):
    frame = visits(spark, random_visits(9, 3))
    window = DayWindow(date(1990, 1, 1), date(1992, 12, 31))
    config = AnalysisConfig(window=window, months=InsightMonths.of(window))
    wanted = sorted(map(str, cohort.cohort_retention(frame, config).collect()))
    for months in (MonthRange.of(window), MonthRange(1985 * 12 + 3, 400)):
        assert sorted(map(str, cohort.cohort_retention(frame, config, months).collect())) == wanted
    with pytest.raises(PySparkException, match="no place for the activity"):
        cohort.cohort_retention(frame, config, MonthRange(1990 * 12 + 1, 12)).collect()


def test_no_members(spark):
    empty = visits(spark, [(None, date(1990, 1, 1)), (4, None)])
    assert cohort.cohort_retention(empty, AnalysisConfig()).count() == 0 and cohort.orders_with_cohort(empty).count() == 0


def test_bits_shuffle_fewer_rows_than_months(spark):
    """Against distinct members and months with a window over each member."""
    clean = facts.line_facts(star_lines(spark, f"{TESTDATA}/sf0.01", FACT_INPUT), STAR_CONFIG.rules)
    by_bits = cohort.cohort_retention(clean, STAR_CONFIG, MonthRange.of(STAR_CONFIG.window))
    active = clean.filter("CustomerID is not null").select("CustomerID", month_index(F.col("order_date")).alias("month")).distinct()
    since = active.withColumn("month_diff", F.col("month") - F.min("month").over(Window.partitionBy("CustomerID")))
    by_months = since.filter("month_diff between 0 and 11").groupBy((F.col("month") - F.col("month_diff")).alias("cohort"), "month_diff").count()
    bits, months = shuffled_rows(by_bits), shuffled_rows(by_months)
    assert by_bits.count() == by_months.count() and 0 < bits < months / 2, (bits, months)
