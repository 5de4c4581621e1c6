"""Metrics that are gathered while a frame is written, so that they need no job of their own.

They are taken in the stage that writes, where each task counts once however often it had to be started. Only measures
without distinct counts can be had in this way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation


def observed(frame: DataFrame, measures: list[Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The frame to write, and what gives ``frame.agg(*measures)`` as a local row once that is written.

    The row is there after the first action on the returned frame; asking for it earlier waits for that.
    """
    row = frame.agg(*measures)
    metrics = Observation()

    def gathered() -> DataFrame:
        found = metrics.get
        return frame.sparkSession.createDataFrame([tuple(found[name] for name in row.columns)], row.schema)

    return frame.observe(metrics, *measures), gathered
