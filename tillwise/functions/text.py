"""Display text for the report feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(value: Column, digits: int = 0) -> Column:
    """Number with thousands separators and a fixed number of decimals."""
    return F.format_number(value.cast("decimal(38,6)"), digits)


def percent_text(value: Column) -> Column:
    """Percentage as short text: 20.45 -> '20.45%', 20.0 -> '20%'."""
    return F.concat(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit("%"))


def fill(template: str, **values: Column) -> Column:
    """Text with its ``{name}`` places taken by columns; NULL if one of them is NULL."""
    parts = [(text, values.get(name)) for text, name, _, _ in Formatter().parse(template)]
    return F.concat(*[part for text, value in parts for part in (F.lit(text), value) if part is not None])


def band(value: Column, bands: Sequence[tuple[float, str]], below: str) -> Column:
    """Name of the first band (highest threshold first) the value reaches; NULL stays NULL."""
    chain = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for threshold, name in bands:
        chain = chain.when(value >= threshold, F.lit(name))
    return chain.otherwise(F.lit(below))


def label_of(key: Column, labels: Mapping[str, str]) -> Column:
    """Display label of a key; a key without a label stands for itself."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
