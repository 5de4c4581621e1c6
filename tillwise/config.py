"""Parameters of the analyses. Nothing here touches Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from tillwise import fixed_values


@dataclass(frozen=True)
class CleaningRules:
    """Thresholds of the five ordered cleaning rules."""

    cancel_prefix: str = fixed_values.CANCEL_PREFIX
    min_code_length: int = fixed_values.MIN_CODE_LENGTH
    outlier_quantities: tuple[int, ...] = fixed_values.OUTLIER_QUANTITIES


@dataclass(frozen=True)
class DayWindow:
    """Observed days, both ends included."""

    start: date = fixed_values.FIRST_DAY
    end: date = fixed_values.LAST_DAY

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"window ends {self.end} before it starts {self.start}")

    def month(self, month: str) -> DayWindow:
        """The days of one ``yyyy-MM`` month that lie inside this window."""
        first, last = month_bounds(month)
        if last < self.start or first > self.end:
            raise ValueError(f"no day of {month} lies between {self.start} and {self.end}")
        return DayWindow(max(first, self.start), min(last, self.end))

    def neighbour(self, month: str, offset: int) -> str:
        """The month some months away, or the first or last month if that one is outside."""
        year, number = divmod(month_bounds(month)[0].year * 12 + int(month[5:]) - 1 + offset, 12)
        return min(max(f"{year:04d}-{number + 1:02d}", self.first_month), self.last_month)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def first_month(self) -> str:
        return f"{self.start:%Y-%m}"

    @property
    def last_month(self) -> str:
        return f"{self.end:%Y-%m}"

    @property
    def last_month_is_partial(self) -> bool:
        return (self.end + timedelta(days=1)).day != 1


@dataclass(frozen=True)
class InsightMonths:
    """Months and cohort quoted by the headline insights."""

    base: str = fixed_values.BASE_MONTH
    peak: str = fixed_values.PEAK_MONTH
    last: str = fixed_values.LAST_MONTH
    cohort: str = fixed_values.LONG_COHORT
    cohort_offset: int = fixed_values.LONG_OFFSET

    @classmethod
    def of(cls, window: DayWindow) -> InsightMonths:
        """The same choice for another window: its second, last but one and last month, and its first cohort."""
        return cls(
            base=window.neighbour(window.first_month, 1),
            peak=window.neighbour(window.last_month, -1),
            last=window.last_month,
            cohort=window.first_month,
        )


@dataclass(frozen=True)
class AnalysisConfig:
    rules: CleaningRules = field(default_factory=CleaningRules)
    window: DayWindow = field(default_factory=DayWindow)
    months: InsightMonths = field(default_factory=InsightMonths)
    max_month_diff: int = fixed_values.MAX_MONTH_DIFF

    @property
    def matrix_offsets(self) -> range:
        return range(1, self.max_month_diff + 1)


def month_bounds(month: str) -> tuple[date, date]:
    """First and last day of a ``yyyy-MM`` month."""
    first = date.fromisoformat(f"{month}-01")
    next_first = (first + timedelta(days=31)).replace(day=1)
    return first, next_first - timedelta(days=1)


def month_slug(month: str) -> str:
    """``2011-11`` as ``nov_2011``, the form used in insight names."""
    first, _ = month_bounds(month)
    return f"{month_name(month)}_{first.year}"


def month_name(month: str) -> str:
    # English names whatever the process locale, so no strftime("%b").
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    return names[month_bounds(month)[0].month - 1]
