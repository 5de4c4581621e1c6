"""The core analyses against plain Python on random lines with every kind of gap and oddity."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from helpers import line, lines

from tillwise.config import AnalysisConfig, CleaningRules, DayWindow
from tillwise.operators import cohort, facts, followups, guest, kpi, profile, quality
from tillwise.registry.queries import portable

CONFIG = AnalysisConfig(
    rules=CleaningRules(outlier_quantities=(40, 41)), window=DayWindow(date(2011, 1, 10), date(2012, 6, 20))
)
RULES, WINDOW = CONFIG.rules, CONFIG.window


def random_lines(seed: int, n: int = 1500):
    rng = random.Random(seed)
    # Some days outside the window, whole months without lines, one hot invoice over two months.
    days = [date(2011, 1, 1) + timedelta(days=d) for d in range(560) if (d // 30) % 5 != 3]
    bills = [
        (rng.choice(["", "", "", "C", "c"]) + str(b), rng.choice(days), rng.choice([None, *range(25)])) for b in range(350)
    ]
    rows = []
    for _ in range(n):
        number, day, customer = rng.choice(bills)
        if rng.random() < 0.3:
            number, day, customer = "900", date(2011, 5, 31) + timedelta(days=rng.randint(0, 1)), 24
        if rng.random() < 0.05:
            customer = None
        stamp = datetime(day.year, day.month, day.day, rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))
        rows.append(
            line(
                invoice=None if rng.random() < 0.02 else number,
                code=rng.choice(["POST", "12345", "85123A", "SKU0001", "", None]),
                quantity=rng.choice([None, 0, -3, 40, 41, *range(1, 9)]),
                when=stamp.isoformat(sep=" "),
                price=rng.choice([None, "0", "0.005", "1.25", "3.3333", "19.99"]),
                customer=customer,
                country=rng.choice(["UK", "FR"]),
            )
        )
    return rows


def half_up(value) -> float:
    return float(Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP))


def percent(part, whole):
    return half_up(Decimal(part) * 100 / Decimal(whole)) if whole else None


def passed(row) -> int:
    invoice, code, _, quantity, _, price, _, _ = row
    rules = [
        invoice is not None and not invoice.startswith("C"),
        code is not None and len(code) >= 5,
        quantity is not None and quantity > 0,
        price is not None and price > 0,
        quantity not in (40, 41),
    ]
    return next((n for n, ok in enumerate(rules) if not ok), 5)


def month(day) -> str:
    return f"{day:%Y-%m}"


def offset(later, earlier) -> int:
    return (later.year - earlier.year) * 12 + later.month - earlier.month


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = random_lines(request.param)
    frame = lines(spark, *rows).cache()
    clean = [r for r in rows if passed(r) == 5]
    ledger = facts.order_ledger(frame, RULES).cache()
    grains = [facts.line_facts(frame, RULES), facts.ledger_facts(ledger, RULES)]
    return rows, clean, frame, ledger, grains


def got(frame, *order):
    return [tuple(r) for r in portable(frame).orderBy(*order).collect()]


def test_funnel_and_profiles(case):
    rows, clean, frame, ledger, grains = case
    counts = [sum(passed(r) >= n for r in rows) for n in range(6)]
    assert list(quality.step_counts(frame, RULES).first()) == counts
    assert list(quality.step_counts_of_ledger(ledger, RULES).first()) == counts
    stamps = sorted(r[4] for r in rows)
    raw = (len(rows), 8, str(stamps[0]), str(stamps[-1]), len({r[0] for r in rows if r[0]}))
    raw += (len({r[6] for r in rows} - {None}),)
    assert tuple(profile.profile_raw(frame).first()) == tuple(profile.profile_raw_of_ledger(ledger).first()) == raw
    guests = sum(r[6] is None for r in clean)
    expected = (
        len(clean),
        half_up(sum(r[3] * r[5] for r in clean)),
        len({r[0] for r in clean}),
        len({r[6] for r in clean}),
        guests,
        percent(guests, len(clean)),
    )
    for grain in grains:
        assert tuple(profile.profile_clean(grain).first()) == expected


def test_growth(case):
    _, clean, _, _, grains = case
    per_day = {WINDOW.start + timedelta(days=n): [Decimal(0), set(), set()] for n in range(WINDOW.days)}
    for invoice, _, _, quantity, stamp, price, customer, _ in clean:
        if stamp.date() in per_day:
            entry = per_day[stamp.date()]
            entry[0] += quantity * price
            entry[1].add(customer)
            entry[2].add(invoice)
    per_month = defaultdict(list)
    for day, entry in per_day.items():
        per_month[month(day)].append((entry[0], len(entry[1]), len(entry[2])))
    expected, before = [], None
    for name, values in sorted(per_month.items()):
        means = [half_up(Decimal(sum(v[i] for v in values)) / len(values)) for i in range(3)]
        changes = [
            percent(Decimal(str(m)) - Decimal(str(b)), Decimal(str(b))) for m, b in zip(means, before, strict=True)
        ] if before else [None] * 3
        expected.append((name, *means, *changes))
        before = means
    assert any(row[1] == 0 for row in expected)
    for grain in grains:
        assert got(kpi.add_mom(kpi.monthly_kpi(kpi.daily_stats(grain, WINDOW))), "order_month") == expected


def test_retention(case):
    _, clean, _, _, grains = case
    visits = defaultdict(set)
    for r in clean:
        if r[6] is not None:
            visits[r[6]].add(r[4].date())
    sizes, cells = defaultdict(int), defaultdict(int)
    for days in visits.values():
        first = min(days)
        sizes[month(first)] += 1
        for k in {offset(d, first) for d in days if offset(d, first) <= 11}:
            cells[month(first), k] += 1
    long = sorted((c, k, n, sizes[c], percent(n, sizes[c])) for (c, k), n in cells.items())
    matrix = [
        (c, n, *[percent(cells[c, k], n) if (c, k) in cells else None for k in range(1, 12)])
        for c, n in sorted(sizes.items())
    ]
    for grain in grains:
        retention = cohort.cohort_retention(grain, CONFIG)
        assert got(retention, "cohort_month", "month_diff") == long
        assert got(cohort.cohort_matrix(retention, CONFIG), "cohort_month") == matrix


def test_guests(case):
    _, clean, _, _, grains = case
    bills = defaultdict(list)
    for r in clean:
        bills[month(r[4]), r[0]].append(r)
    assert ("2011-05", "900") in bills and ("2011-06", "900") in bills
    months = defaultdict(list)
    for (name, _), rows in bills.items():
        months[name].append((all(r[6] is None for r in rows), sum(r[3] * r[5] for r in rows)))
    expected = []
    for name, orders in sorted(months.items()):
        guest_revenue = [v for is_guest, v in orders if is_guest]
        mean = half_up(sum(guest_revenue) / len(guest_revenue)) if guest_revenue else None
        shares = percent(len(guest_revenue), len(orders)), percent(sum(guest_revenue), sum(v for _, v in orders))
        expected.append((name, len(guest_revenue), len(orders), *shares, mean))
    for grain in grains:
        assert got(guest.guest_metrics(guest.order_level(grain)), "order_month") == expected


def test_outlier_effect_of_each_month(case):
    rows, _, frame, ledger, _ = case
    for name in ("2011-01", "2011-02", "2011-04", "2012-06"):
        days = WINDOW.month(name)
        values = [Decimal(0), Decimal(0)]
        for r in rows:
            if passed(r) >= 4 and days.start <= r[4].date() <= days.end:
                values[0] += r[3] * r[5]
                values[1] += r[3] * r[5] if passed(r) == 5 else 0
        expected = (name, *[half_up(v / days.days) for v in values])
        by_line = quality.revenue_by_rule(frame, RULES, days)
        by_ledger = quality.revenue_by_rule_of_ledger(ledger)
        assert tuple(quality.outlier_sensitivity(by_line, days).first()) == expected
        assert tuple(quality.outlier_sensitivity(by_ledger, days).first()) == expected


def test_member_returns(case):
    _, clean, _, _, grains = case
    visits = defaultdict(set)
    for r in clean:
        if r[6] is not None:
            visits[r[6]].add(r[4].date())
    expected = sorted((c, *(sorted(d) + [None])[:2]) for c, d in visits.items())
    for grain in grains:
        returns = followups.member_returns(grain).select("CustomerID", "first_day", "second_day")
        assert sorted(map(tuple, returns.collect())) == expected
