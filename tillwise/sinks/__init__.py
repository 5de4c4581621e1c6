"""Writers for the small result tables and the documents, and their publication as one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillwise.operators.documents import to_json_text
from tillwise.operators.observed import observed
from tillwise.operators.quality import output_check_rows, output_measures
from tillwise.sources.shared import file_of

_ASIDE, _BEFORE = ".writing-", ".before-"


def write_csv(result: DataFrame, path: str, order_by: list[str]) -> DataFrame:
    """A result of at most one row per month, cohort or step as one CSV part with a header.

    Returns its output check, which is gathered by the job that writes.
    """
    single, gathered = observed(_ordered(result, order_by), output_measures(result.schema))
    single.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return output_check_rows(gathered(), result.schema)


def write_json(document: DataFrame, path: str) -> None:
    """A one-row document as one JSON text."""
    to_json_text(document, pretty=True).coalesce(1).write.mode("overwrite").text(path)


def _ordered(result: DataFrame, order_by: list[str]) -> DataFrame:
    # One part on purpose: these tables stay small however many lines they summarize.
    single = result.coalesce(1)
    return single.sortWithinPartitions(*order_by) if order_by else single


@contextmanager
def publication(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder to write several results to, which then take the place of ``folder`` as one.

    >>> with publication(spark, "/results") as aside:
    ...     write_csv(kpi, f"{aside}/monthly_kpi.csv", ["order_month"])
    ...     write_json(summary, f"{aside}/analysis_summary.json")

    Results are written to a folder beside the target and become visible by a rename, so a reader sees all old or all new ones. If
    anything fails before that, the old results stay as they were and what was written goes. A target that exists is moved aside first; if the driver
    is lost between the two renames, the next publication, or ``recover``, moves it back. One publication at a time may have a target.
    In a store without atomic renames of folders, as object stores are, publish to a folder of the day instead.
    """
    folder = folder.rstrip("/")
    recover(spark, folder)
    mark = uuid.uuid4().hex
    aside, before = f"{folder}{_ASIDE}{mark}", f"{folder}{_BEFORE}{mark}"
    target, store = file_of(spark, folder)
    try:
        yield aside
        if store.exists(target):
            _rename(spark, folder, before)
        try:
            _rename(spark, aside, folder)
        except BaseException:
            recover(spark, folder)
            raise
        store.delete(file_of(spark, before)[0], True)
    finally:
        store.delete(file_of(spark, aside)[0], True)


def recover(spark: SparkSession, folder: str) -> None:
    """Brings back the results that a lost driver had moved aside, and removes what it left half written."""
    folder = folder.rstrip("/")
    target, store = file_of(spark, folder)
    parent = target.getParent()
    if parent is None or not store.exists(parent):
        return
    left = re.compile(rf"{re.escape(target.getName())}({re.escape(_ASIDE)}|{re.escape(_BEFORE)})[0-9a-f]{{32}}$")
    for status in store.listStatus(parent):
        found = left.match(status.getPath().getName())
        if found and found[1] == _BEFORE and not store.exists(target):
            _rename(spark, status.getPath().toString(), folder)
        elif found:
            store.delete(status.getPath(), True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    (path, store), (goal, _) = file_of(spark, source), file_of(spark, target)
    if not store.rename(path, goal):
        raise OSError(f"could not rename {source} to {target}")
