"""Column helpers built from Spark's own functions."""

from tillwise.functions.dates import day_range, month_diff, month_index, month_text, month_text_of_index
from tillwise.functions.numeric import pct, pct_change, ratio, round2
from tillwise.functions.text import band, fill, label_of, percent_text, thousands

__all__ = [
    "band",
    "day_range",
    "fill",
    "label_of",
    "month_diff",
    "month_index",
    "month_text",
    "month_text_of_index",
    "pct",
    "pct_change",
    "percent_text",
    "ratio",
    "round2",
    "thousands",
]
