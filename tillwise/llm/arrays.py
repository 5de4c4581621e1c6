"""Positions within arrays, by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doublings of the distance; arrays have fewer than 2^31 elements.
_DOUBLINGS = 31


def with_running_sum(items: Column, field: str, fields: list[str]) -> Column:
    """The structs with ``field``, a number without nulls, replaced by its sum up to and with each of them.

    Each element adds the sum that stands 1, 2, 4, ... places before it, so an array of n elements takes n log n steps;
    no list grows by one element at a time. An empty array stays empty, a null one null.
    """

    def add(sums: Column, distance: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            whole = x[field] + F.coalesce(F.get(sums, i - distance)[field], F.lit(0))
            return F.struct(*[(whole if name == field else x[name]).alias(name) for name in fields])

        return F.when(F.size(sums) > distance, F.transform(sums, one)).otherwise(sums)

    distances = F.array(*[F.lit(1 << k) for k in range(_DOUBLINGS)])
    return F.aggregate(distances, items, add)
