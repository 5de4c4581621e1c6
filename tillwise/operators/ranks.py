"""Values of exact ranks, and so exact quantiles, by distributed selection.

1. Approximate quantiles a little below and above each wanted one bracket it. One pass.
2. A second pass combines what lies inside a bracket to one row per value, and each gap between brackets to one row
   with its count. These rows stand for all values in order. They are range-partitioned and written.
3. The counts per range, one row each, are summed up from the first range on, which tells the range that holds a rank.
4. Only that range is looked into. If it has more rows than one task should sort, it is range-partitioned again.

A rank that falls into a gap, which the accuracy of the approximation rules out, is looked for between the gap's ends in the same way.
No step sorts all values or a whole bracket in one task, however skewed the values are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.sources.shared import Tables, stage

#: Rows, one per distinct value, that a task may sort to find a rank in its range.
MOST_ROWS = 1_000_000
#: Accuracy of the approximate quantiles; a bracket holds about four in this many of all values.
ACCURACY = 10_000


@dataclass(frozen=True)
class Selected:
    """A value, its rank among all, and how many rows, one per distinct value, were sorted to find it."""

    value: Any
    rank: int
    sorted_rows: int


def exact_quantile(frame: DataFrame, column: str, q: float) -> Any:
    """The smallest value with at least a share q of all values at or below it; None without values. See ``exact_quantiles``."""
    found = exact_quantiles(frame, column, [q])
    return found[0].value if found else None


def exact_quantiles(frame: DataFrame, column: str, qs: list[float], *, accuracy: int = ACCURACY) -> list[Selected]:
    """For each q the smallest value with at least a share q of all values at or below it; empty without values.

    Shares count as written: 0.07 of 100 values are 7. NULLs are no values. The frame is read twice; only the answers, the brackets and one
    count per range reach the driver.
    """
    values = frame.select(F.col(column).alias("v")).filter("v is not null")
    margin = 2 / accuracy
    sides = [F.lit(min(1.0, max(0.0, q + side))) for q in qs for side in (-margin, margin)]
    found = values.agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*sides), accuracy).alias("sides")).first()
    if found["n"] == 0:
        return []
    ranks = [min(found["n"], max(1, math.ceil(Fraction(str(q)) * found["n"]))) for q in qs]
    brackets = _merged(list(zip(found["sides"][::2], found["sides"][1::2], strict=True)))
    with Tables(frame.sparkSession):
        rows = _in_order(values, brackets)
        return [_selected(values, rows, brackets, rank) for rank in ranks]


def _merged(brackets: list[tuple]) -> list[tuple]:
    """Brackets without overlaps, in order."""
    out: list[tuple] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _place(brackets: list[tuple]) -> Column:
    """2i + 1 for values in the i-th bracket, 2i for those in the gap before it."""
    place = None
    for i, (low, high) in enumerate(brackets):
        for number, test in ((2 * i, F.col("v") < F.lit(low)), (2 * i + 1, F.col("v") <= F.lit(high))):
            place = F.when(test, number) if place is None else place.when(test, number)
    return place.otherwise(2 * len(brackets))


def _in_order(values: DataFrame, brackets: list[tuple]) -> DataFrame:
    """All values as rows (place, v, n, range): a row per value inside a bracket, and one with a NULL for each gap; staged by range."""
    placed = values.select(_place(brackets).alias("place"), "v")
    inside = F.when(F.col("place") % 2 == 1, F.col("v"))
    return _ranges(placed.groupBy("place", inside.alias("v")).agg(F.count(F.lit(1)).alias("n")))


def _ranges(rows: DataFrame) -> DataFrame:
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(max(2, ranges), "place", "v")
    return stage(dealt.withColumn("range", F.spark_partition_id()), "ranges")


def _selected(values: DataFrame, rows: DataFrame, brackets: list[tuple], rank: int) -> Selected:
    left = rank
    while True:
        counts = rows.groupBy("range").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("range").collect()
        for count in counts:
            if left <= count["n"]:
                break
            left -= count["n"]
        here = rows.filter(F.col("range") == count["range"])
        if count["rows"] <= MOST_ROWS:
            break
        rows = _ranges(here.drop("range"))
    up_to = F.sum("n").over(Window.partitionBy("range").orderBy("place", F.asc_nulls_first("v")))
    hit = here.withColumn("up_to", up_to).filter((F.col("up_to") >= left) & (F.col("up_to") - F.col("n") < left)).first()
    if hit["v"] is not None:
        return Selected(hit["v"], rank, count["rows"])
    # The rank lies in a gap, between the bracket before it and the one after it.
    gap = hit["place"] // 2
    within = values.filter(_place(brackets) == hit["place"])
    low, high = (brackets[gap - 1][1] if gap else None), (brackets[gap][0] if gap < len(brackets) else None)
    if low is None or high is None:
        ends = within.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
        low, high = (ends["low"] if low is None else low), (ends["high"] if high is None else high)
    inner = [(low, high)]
    found = _selected(within, _in_order(within, inner), inner, left - (hit["up_to"] - hit["n"]))
    return Selected(found.value, rank, found.sorted_rows)
