"""Which months a member was active in, as bits: one row per member, however long and busy the member's history.

A set bit stands for a month with an order, counted from the first month of a range. A word holds 63 months, so that it is never
negative; longer ranges take several words. Bits combine with OR before and after the shuffle, so a member reaches it as one row
per input task, and cohorts, offsets and retention follow from the bits without another shuffle of members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.config import DayWindow
from tillwise.functions import month_index

WORD_MONTHS = 63


@dataclass(frozen=True)
class MonthRange:
    """Months from ``first``, as counted by ``month_index``."""

    first: int
    months: int

    @classmethod
    def of(cls, window: DayWindow) -> MonthRange:
        first, last = (day.year * 12 + day.month - 1 for day in (window.start, window.end))
        return cls(first, last - first + 1)

    @property
    def words(self) -> int:
        return -(-self.months // WORD_MONTHS)


def observed_months(facts: DataFrame) -> MonthRange:
    """The months of the facts, by a job that reads their days alone."""
    month = month_index(F.col("order_date"))
    ends = facts.filter(F.col("CustomerID").isNotNull()).agg(F.min(month).alias("first"), F.max(month).alias("last")).first()
    return MonthRange(0, 1) if ends["first"] is None else MonthRange(ends["first"], ends["last"] - ends["first"] + 1)


def member_activity(facts: DataFrame, months: MonthRange) -> DataFrame:
    """(CustomerID, words, cohort): a member's active months as words of bits, and the place of the first one.

    Facts without a member or a day do not count. A day outside of the range fails the query: no activity is lost in silence.
    """
    place = month_index(F.col("order_date")) - months.first
    known = F.raise_error(F.concat(F.lit("no place for the activity of "), F.col("order_date").cast("string"))).cast("int")
    placed = facts.filter(F.col("CustomerID").isNotNull() & F.col("order_date").isNotNull()).select(
        "CustomerID", F.when(place.between(0, months.months - 1), place).otherwise(known).alias("place")
    )
    bits = []
    for word in range(months.words):
        start = word * WORD_MONTHS
        here = F.col("place").between(start, start + WORD_MONTHS - 1)
        bits.append(F.coalesce(F.bit_or(F.when(here, F.expr(f"shiftleft(1L, place - {start})"))), F.lit(0).cast("long")).alias(f"word_{word}"))
    return (
        placed.groupBy("CustomerID")
        .agg(*bits)
        .select("CustomerID", F.array(*[f"word_{w}" for w in range(months.words)]).alias("words"), _first_place(months).alias("cohort"))
    )


def _first_place(months: MonthRange) -> Column:
    """The place of the lowest set bit: the bits below it are those of the lowest bit less one."""
    found = None
    for word in range(months.words):
        bits = F.col(f"word_{word}")
        place = F.bit_count(bits.bitwiseAND(-bits) - 1) + word * WORD_MONTHS
        found = F.when(bits != 0, place) if found is None else found.when(bits != 0, place)
    return found.cast("int")


def active_after(offset: Column) -> Column:
    """Whether a member of ``member_activity`` was active so many months after the first one."""
    place = F.col("cohort") + offset
    word = F.get("words", F.floor(place / WORD_MONTHS).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, F.pmod(place, F.lit(WORD_MONTHS))).bitwiseAND(1) == 1, F.lit(False))


def member_offsets(activity: DataFrame, months: MonthRange) -> DataFrame:
    """One row per member and active month: CustomerID, cohort as a month index, month_diff."""
    offsets = F.filter(F.sequence(F.lit(0), F.lit(months.months - 1) - F.col("cohort")), active_after)
    laid_out = activity.select("CustomerID", F.col("cohort").alias("place"), F.explode(offsets).alias("month_diff"))
    return laid_out.select("CustomerID", (F.col("place") + months.first).alias("cohort"), "month_diff")


def cohort_counts(activity: DataFrame, months: MonthRange, most: int) -> DataFrame:
    """(cohort, month_diff, retained_users, new_users) for offsets up to ``most``; no row where nobody was active.

    Each cohort is one row of counts until it is laid out, so what is shuffled are cohorts.
    """
    counts = [F.count_if(active_after(F.lit(k))).alias(f"after_{k}") for k in range(most + 1)]
    rows = [F.struct(F.lit(k).alias("month_diff"), F.col(f"after_{k}").alias("retained_users")) for k in range(most + 1)]
    counted = activity.groupBy("cohort").agg(*counts)
    laid_out = counted.select((F.col("cohort") + months.first).alias("cohort"), F.inline(F.array(*rows)), F.col("after_0").alias("new_users"))
    return laid_out.filter("retained_users > 0")
