"""The ordered cleaning rules, and the columns derived from a line."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.config import CleaningRules
from tillwise.fixed_values import GUEST_KEY, STEP_DESCRIPTIONS
from tillwise.functions import month_text


def cleaning_steps(rules: CleaningRules) -> dict[str, Column]:
    """The five rules in order, as what they keep. A NULL in a tested column fails the rule."""
    return {
        "remove_cancel_invoice": ~F.col("InvoiceNo").startswith(rules.cancel_prefix),
        "remove_short_stock_code": F.length("StockCode") >= rules.min_code_length,
        "remove_non_positive_quantity": F.col("Quantity") > 0,
        "remove_non_positive_unit_price": F.col("UnitPrice") > 0,
        "remove_quantity_outliers": ~F.col("Quantity").isin(*rules.outlier_quantities),
    }


def step_descriptions(rules: CleaningRules) -> dict[str, str]:
    """What each funnel step does, from the raw lines on, with the thresholds in use."""
    thresholds = {
        "prefix": rules.cancel_prefix,
        "length": rules.min_code_length,
        "outliers": ", ".join(str(q) for q in rules.outlier_quantities),
    }
    return {name: text.format(**thresholds) for name, text in STEP_DESCRIPTIONS.items()}


def apply_step(lines: DataFrame, rules: CleaningRules, name: str) -> DataFrame:
    """One rule on its own."""
    return lines.filter(cleaning_steps(rules)[name])


def steps_passed(rules: CleaningRules) -> Column:
    """How many rules a line passes before the first one that it fails."""
    first, *others = [~F.coalesce(keeps, F.lit(False)) for keeps in cleaning_steps(rules).values()]
    passed = F.when(first, F.lit(0))
    for n, fails in enumerate(others, start=1):
        passed = passed.when(fails, F.lit(n))
    return passed.otherwise(F.lit(len(others) + 1))


def is_clean(rules: CleaningRules) -> Column:
    return reduce(and_, cleaning_steps(rules).values())


def is_clean_but_for_outliers(rules: CleaningRules) -> Column:
    return reduce(and_, list(cleaning_steps(rules).values())[:-1])


def is_outlier(rules: CleaningRules) -> Column:
    """Fails the last rule only. Written with IN so that a scan can use it."""
    return is_clean_but_for_outliers(rules) & F.col("Quantity").isin(*rules.outlier_quantities)


def clean(lines: DataFrame, rules: CleaningRules) -> DataFrame:
    return lines.filter(is_clean(rules))


def member_lines(lines: DataFrame) -> DataFrame:
    """Lines with a customer id, the id also as text."""
    return lines.filter(F.col("CustomerID").isNotNull()).withColumn("customer_id", F.col("CustomerID").cast("string"))


def line_revenue() -> Column:
    return F.col("Quantity") * F.col("UnitPrice")


def customer_key() -> Column:
    """The id as text; all lines without one share the key 'Guest'."""
    return F.coalesce(F.col("CustomerID").cast("string"), F.lit(GUEST_KEY))


def enrich(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "line_revenue": line_revenue(),
            "customer_key": customer_key(),
            "order_date": F.to_date("InvoiceDate"),
            "order_month": month_text(F.col("InvoiceDate")),
        }
    )
