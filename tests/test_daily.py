"""A ledger that grows by days gives the report of all lines, whatever was merged when."""

from __future__ import annotations

import random
from dataclasses import fields
from datetime import date
from pathlib import Path

import pytest
from helpers import line, lines
from pyspark.sql import DataFrame

from tillwise import sinks
from tillwise.__main__ import main
from tillwise.config import AnalysisConfig, CleaningRules, DayWindow, InsightMonths
from tillwise.operators.facts import order_ledger
from tillwise.plans.daily import LedgerStore
from tillwise.plans.growth import growth_report

RULES = CleaningRules(outlier_quantities=(49, 50))
WINDOW = DayWindow(date(2010, 12, 1), date(2011, 2, 28))
CONFIG = AnalysisConfig(rules=RULES, window=WINDOW, months=InsightMonths.of(WINDOW))
DAYS = ["2010-12-01", "2010-12-02", "2010-12-31", "2011-01-05", "2011-02-01"]


def day_rows(day, seed, n=40):
    dice = random.Random(f"{day}{seed}")
    when = lambda: f"{day} {dice.randrange(8, 20):02d}:{dice.randrange(60):02d}:00"
    return [
        line(
            invoice=dice.choice(["", "", "", "C"]) + str(536_365 + dice.randrange(12)), code=dice.choice(["85123A", "POST"]),
            quantity=dice.choice([-1, 1, 3, 49]), when=when(), price=dice.choice(["0", "2.5", "1.25"]), customer=dice.choice([1, 2, 3, 4, None]),
        )
        for _ in range(n)
    ]


def text(frame):
    return sorted(map(str, frame.collect()))


def same_report(one, other):
    for f in fields(one):
        got, wanted = getattr(one, f.name), getattr(other, f.name)
        assert not isinstance(got, DataFrame) or text(got) == text(wanted), f.name
    assert text(one.summary) == text(other.summary) and text(one.dashboard) == text(other.dashboard)


def test_reports_of_merged_days_equal_those_from_scratch(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"), RULES)
    with pytest.raises(ValueError, match="no day"):
        store.window()
    known = {day: day_rows(day, 1) for day in DAYS[:3]}
    done = store.merge(lines(spark, *[r for of in known.values() for r in of]))
    assert (done.lines, done.added, done.replaced) == (120, 3, 0)
    # A new day: its lines alone are read.
    known[DAYS[3]] = day_rows(DAYS[3], 1, 7)
    done = store.merge(lines(spark, *known[DAYS[3]]))
    assert (done.lines, done.added, done.replaced) == (7, 1, 0)
    same_report(store.report(CONFIG, "x"), growth_report(lines(spark, *[r for of in known.values() for r in of]), CONFIG, "x"))
    # The first day again with other lines, so that first orders move, and a day more; lines without a day too.
    known |= {DAYS[0]: day_rows(DAYS[0], 2, 3), DAYS[4]: day_rows(DAYS[4], 1), None: [line(when=None), line(when=None, customer=9)]}
    done = store.merge(lines(spark, *known[DAYS[0]], *known[DAYS[4]], *known[None]))
    assert (done.lines, done.added, done.replaced) == (45, 2, 1)
    whole = lines(spark, *[r for of in known.values() for r in of])
    assert text(store.ledger()) == text(order_ledger(whole, RULES).select(store.ledger().columns))
    same_report(store.report(CONFIG, "x"), growth_report(whole, CONFIG, "x"))
    done = store.merge(lines(spark, *known[None]))
    assert (done.lines, done.added, done.replaced) == (2, 0, 1)
    assert store.window() == DayWindow(date(2010, 12, 1), date(2011, 2, 1))
    # One folder per day and merge is left, and other rules have a ledger of their own.
    assert len(list((tmp_path / "store").glob("rules-*/days/order_date=*/merge=*"))) == len(known)
    assert LedgerStore(spark, str(tmp_path / "store"), CleaningRules()).ledger().count() == 0
    assert store.merge(lines(spark)).lines == 0 and len(text(store.ledger())) == order_ledger(whole, RULES).count()


@pytest.mark.parametrize("broken", ["list", "delete"])
def test_a_failing_merge_changes_nothing_or_is_whole(spark, tmp_path, monkeypatch, broken):
    store = LedgerStore(spark, str(tmp_path / "store"), RULES)
    old, new = day_rows(DAYS[0], 1), day_rows(DAYS[0], 2) + day_rows(DAYS[1], 2)
    store.merge(lines(spark, *old))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(*((sinks, "_rename", fail) if broken == "list" else ("tillwise.plans.daily.delete", fail)))
        with pytest.raises(OSError, match="lost"):
            store.merge(lines(spark, *new))
    assert text(store.ledger()) == text(order_ledger(lines(spark, *(old if broken == "list" else new)), RULES).select(store.ledger().columns))
    assert store.merge(lines(spark, *new)).lines == 80
    assert text(store.ledger()) == text(order_ledger(lines(spark, *new), RULES).select(store.ledger().columns))


def test_the_command_line_merges(spark, tmp_path, capsys):
    for number, day in enumerate(DAYS[:2]):
        lines(spark, *day_rows(day, 1)).write.parquet(str(tmp_path / f"day{number}"))
        main([str(tmp_path / f"day{number}"), str(tmp_path / "out"), "--ledger", str(tmp_path / "ledger")])
        assert "40 lines read, 1 days added, 0 days replaced" in capsys.readouterr().out
    whole = lines(spark, *day_rows(DAYS[0], 1), *day_rows(DAYS[1], 1))
    window = DayWindow(date(2010, 12, 1), date(2010, 12, 2))
    growth_report(whole, AnalysisConfig(window=window, months=InsightMonths.of(window)), "day1").write(str(tmp_path / "plain"))
    parts = lambda name: {p.parent.name: p.read_text() for p in Path(tmp_path, name).rglob("part-*")}
    assert parts("out") == parts("plain")


def test_a_merge_does_not_read_the_days_of_others(spark, tmp_path, monkeypatch):
    """What a merge wrote is known from its own job, so neither the days nor their folders are looked at again."""
    store = LedgerStore(spark, str(tmp_path / "store"), RULES)
    store.merge(lines(spark, *[r for day in DAYS for r in day_rows(day, 1)]))
    with monkeypatch.context() as patched:
        patched.setattr(LedgerStore, "_written", lambda _: pytest.fail("the days were read"))
        done = store.merge(lines(spark, *day_rows(DAYS[4], 2, 9), line(when=None)))
    assert (done.lines, done.added, done.replaced) == (10, 1, 1)
    assert store.merge(lines(spark)).lines == 0
    whole = lines(spark, *[r for day in DAYS[:4] for r in day_rows(day, 1)], *day_rows(DAYS[4], 2, 9), line(when=None))
    assert text(store.ledger()) == text(order_ledger(whole, RULES).select(store.ledger().columns))
