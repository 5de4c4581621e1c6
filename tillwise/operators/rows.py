"""One-row frames: small results as single values that can be put together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Small results computed once, as local frames. Only for results with one row per month, step or cohort.

    The jobs are independent, so they are submitted together and fill each other's gaps.
    """
    with ThreadPoolExecutor(len(frames)) as pool:
        found = list(pool.map(lambda frame: frame.collect(), frames.values()))
    return {
        name: frame.sparkSession.createDataFrame(rows, frame.schema)
        for (name, frame), rows in zip(frames.items(), found, strict=True)
    }


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row. Each is a scalar subquery: a second row anywhere is an error.

    Equal subqueries are run once, however often and however deep they occur in a document.
    """
    values = [row.select(F.struct("*")).scalar().alias(f"row_{n}") for n, row in enumerate(rows)]
    return rows[0].sparkSession.range(1).select(*values).select(*[f"row_{n}.*" for n in range(len(rows))])


def records(frame: DataFrame, name: str, order_by: str) -> DataFrame:
    """A small frame as one row holding an ordered array of its rows.

    Only for results with one row per month or cohort. The sort key leads the sorted struct
    because collect_list promises no order.
    """
    keyed = F.struct(F.col(order_by).alias("sort_key"), F.struct(*frame.columns).alias("record"))
    ordered = F.array_sort(F.collect_list(keyed))
    return frame.agg(F.transform(ordered, lambda item: item["record"]).alias(name))


def as_struct(row: DataFrame, name: str) -> DataFrame:
    return row.select(F.struct(*row.columns).alias(name))


def record_at(array: str, key: str, wanted: str, value: str) -> Column:
    """A value of the first record with the wanted key; NULL without such a record."""
    found = F.filter(array, lambda record: record[key] == wanted)
    return F.get(found, F.lit(0))[value]


def mean_of(array: str, value: str) -> Column:
    """Mean of a value over all records that have one; NULL if none has."""
    present = F.filter(F.transform(array, lambda record: record[value]), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(present).cast("double"))
