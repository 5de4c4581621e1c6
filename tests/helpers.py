"""Hand-made transaction lines."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tillwise.sources import LINE_SCHEMA


def line(
    invoice="536365",
    code="85123A",
    quantity=1,
    when="2010-12-01 08:26:00",
    price="2.50",
    customer=17850,
    country="United Kingdom",
    description="HOLDER",
):
    return (
        invoice,
        code,
        description,
        quantity,
        datetime.fromisoformat(when) if when else None,
        Decimal(price) if price is not None else None,
        customer,
        country,
    )


def lines(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), LINE_SCHEMA)


def shuffled_rows(frame: DataFrame) -> int:
    """Rows that all exchanges of a frame's plan write when it is computed."""
    frame.collect()

    def rows(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows(node.plan())
        if name == "ReusedExchangeExec":
            return 0
        own = 0
        if name == "ShuffleExchangeExec":
            metric = node.metrics().get("shuffleRecordsWritten")
            own = metric.get().value()
        children = node.children()
        return own + sum(rows(children.apply(i)) for i in range(children.size()))

    return rows(frame._jdf.queryExecution().executedPlan())
