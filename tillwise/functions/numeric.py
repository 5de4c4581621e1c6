"""Rounding and ratios: one definition each, used by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, halves away from zero, as DOUBLE.

    Going through a decimal keeps 1.005 from being rounded as the double 1.00499...
    """
    return F.round(value.cast("decimal(38,6)"), 2).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE; NULL when the denominator is zero, in either ANSI mode."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(numerator: Column, denominator: Column) -> Column:
    """Share in percent with two decimals; NULL for a zero denominator."""
    return round2(ratio(numerator, denominator) * 100)


def pct_change(value: Column, previous: Column) -> Column:
    """Change against a previous value in percent; NULL without one or if it is zero."""
    return pct(value - previous, previous)
