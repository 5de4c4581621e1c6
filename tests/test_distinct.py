"""Bitmaps of distinct keys: equal to counting, mergeable, over any grain and any keys."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

from conftest import TESTDATA
from helpers import shuffled_rows
from pyspark.sql import functions as F

from tillwise.config import DayWindow
from tillwise.operators import distinct, facts, kpi, profile
from tillwise.operators.facts import FACT_INPUT
from tillwise.registry import STAR_CONFIG
from tillwise.sources import Tables, stage, star_lines

DDL = "order_date date, InvoiceNo string, CustomerID long, line_revenue decimal(14,4), line_count long"
WINDOW = DayWindow(date(2010, 12, 1), date(2011, 3, 31))


def random_facts(seed, n=3000):
    dice = random.Random(seed)
    invoices = [str(536_365 + i) for i in range(300)] + ["A563185", "0536365", "-5", "0", "32768", "32769", str(10**15), "", " 1"]
    members = [17_850 + i for i in range(80)] + [0, 1, 32_768, 32_769, 10**12, -7, None, None]
    day = lambda: date(2010, 12, 1) + timedelta(dice.randrange(100))
    return [(day(), dice.choice(invoices), dice.choice(members), Decimal(dice.randrange(10**6)) / 100, 1) for _ in range(n)]


def text(frame):
    return sorted(map(str, frame.collect()))


def test_bitmaps_count_like_sets(spark):
    rows = random_facts(1) + [(date(2011, 1, 5), "hot", 99, Decimal(1), 1)] * 2000 + [(date(2011, 2, 1), None, 5, Decimal(2), 1)]
    frame = spark.createDataFrame(rows, DDL).repartition(4)
    state = distinct.distinct_state(frame)
    assert text(distinct.daily_stats(state, WINDOW)) == text(kpi.daily_stats(frame, WINDOW))
    assert text(distinct.profile_clean(state)) == text(profile.profile_clean(frame))
    by_month = distinct.merged(state, F.trunc("order_date", "month").alias("month")).groupBy("month").agg(distinct.distinct("customer"), distinct.distinct("invoice"))
    for month, customers, orders in by_month.collect():
        inside = [r for r in rows if (r[0].year, r[0].month) == (month.year, month.month)]
        assert (customers, orders) == (len({r[2] for r in inside}), len({r[1] for r in inside if r[1] is not None}))


def test_days_merge(spark):
    """Half of the lines now and half later give the same as all at once, also where a day is in both."""
    first, second = random_facts(2, 800), random_facts(3, 800)
    whole = distinct.distinct_state(spark.createDataFrame(first + second, DDL))
    parts = [distinct.distinct_state(spark.createDataFrame(part, DDL)) for part in (first, second)]
    merged = distinct.merged(parts[0].unionByName(parts[1]), F.col("order_date"))
    assert text(distinct.daily_stats(merged, WINDOW)) == text(distinct.daily_stats(whole, WINDOW))
    assert text(distinct.profile_clean(merged)) == text(distinct.profile_clean(whole))


def test_no_lines(spark):
    empty = spark.createDataFrame([], DDL)
    state = distinct.distinct_state(empty)
    assert text(distinct.profile_clean(state)) == text(profile.profile_clean(empty))
    assert text(distinct.daily_stats(state, WINDOW)) == text(kpi.daily_stats(empty, WINDOW))


def test_both_results_shuffle_fewer_rows_than_two_expansions(spark):
    clean = facts.line_facts(star_lines(spark, f"{TESTDATA}/sf0.01", FACT_INPUT), STAR_CONFIG.rules)
    with Tables(spark):
        plain = shuffled_rows(kpi.daily_stats(clean, STAR_CONFIG.window)) + shuffled_rows(profile.profile_clean(clean))
        state = distinct.distinct_state(clean)
        built = shuffled_rows(state)
        state = stage(state, "state")
        read = shuffled_rows(distinct.daily_stats(state, STAR_CONFIG.window)) + shuffled_rows(distinct.profile_clean(state))
    assert built + read < plain, (built, read, plain)


def test_scattered_ids_take_a_word_each(spark):
    """A day with ids all over a wide range takes rows as small as the keys, which are combined by hashing and never sorted."""
    rows = [(date(2011, 1, 5), str(i * 1_000_003), i * 99_991, Decimal(1), 1) for i in range(500)]
    state = distinct.distinct_state(spark.createDataFrame(rows, DDL))
    assert state.schema["bits"].dataType.typeName() == "long"
    for frame in (state, distinct.merged(state), distinct.profile_clean(state)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    counts = distinct.profile_clean(state).first()
    assert (counts["unique_invoices"], counts["customers_including_guest_key"]) == (500, 500)


def test_every_bit_of_a_word_counts(spark):
    """Ids around the ends of words, the sign bit among them, and the largest one."""
    ids = [0, 1, 62, 63, 64, 65, 127, 128, 2**63 - 1, 2**63 - 64]
    rows = [(date(2011, 1, 5 + n % 2), str(i), i, Decimal(1), 1) for n in range(3) for i in ids]
    state = distinct.distinct_state(spark.createDataFrame(rows, DDL).repartition(3))
    counts = distinct.profile_clean(state).first()
    assert (counts["unique_invoices"], counts["customers_including_guest_key"], counts["rows"]) == (10, 10, 30)
    assert state.filter("kind = 'invoice'").count() == 2 * 4
