"""Month arithmetic. Months are grouped as integers and turned into text on small results."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.config import DayWindow


def month_text(day: Column) -> Column:
    """``yyyy-MM`` of a date or timestamp."""
    return F.date_format(day.cast("date"), "yyyy-MM")


def month_index(day: Column) -> Column:
    """Months since year 0: an INT group key on which month differences are subtractions."""
    return F.year(day) * 12 + F.month(day) - 1


def month_text_of_index(index: Column) -> Column:
    year = F.floor(index / 12).cast("int")
    return month_text(F.make_date(year, index - year * 12 + 1, F.lit(1)))


def month_diff(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two dates."""
    return month_index(later) - month_index(earlier)


def day_range(timestamp: Column, window: DayWindow) -> Column:
    """Timestamp inside the window, written on the bare column so that scans can skip files."""
    first = datetime.combine(window.start, time.min)
    after = datetime.combine(window.end + timedelta(days=1), time.min)
    return (timestamp >= _ntz(first)) & (timestamp < _ntz(after))


def _ntz(moment: datetime) -> Column:
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")
