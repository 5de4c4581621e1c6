"""A ledger that grows by days, so that a report on a new day does not read all lines again.

The store keeps the order ledger partitioned by day and by the merge that wrote it, and a list of which merge holds a day.
A merge compacts its lines, writes their days beside the others and then publishes a new list as one; only
after that the days that it replaces are deleted. Whatever fails, readers see every day whole, old or new. One merge at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import sinks
from tillwise.config import AnalysisConfig, CleaningRules, DayWindow
from tillwise.operators.facts import order_ledger
from tillwise.operators.observed import observed
from tillwise.plans.growth import GrowthReport, settled_report
from tillwise.sources.lines import LINE_SCHEMA
from tillwise.sources.shared import delete, file_of

DAYS = "order_date date, merge string"


@dataclass(frozen=True)
class Merged:
    """What a merge read and changed: lines read, days that are new, and days that took the place of older ones."""

    lines: int
    added: int
    replaced: int


class LedgerStore:
    """The ledger at a path under some cleaning rules; other rules have a ledger of their own beside it."""

    def __init__(self, spark: SparkSession, path: str, rules: CleaningRules) -> None:
        self._spark, self._rules = spark, rules
        self._path = f"{path.rstrip('/')}/rules-{sha256(repr(asdict(rules)).encode()).hexdigest()[:12]}"

    def merge(self, lines: DataFrame) -> Merged:
        """Takes in lines that hold their days whole: each of these days replaces what the store has for it.

        Lines without a day are a day of their own. Other days are neither read nor written.
        """
        merge = uuid.uuid4().hex
        ledger = order_ledger(lines, self._rules)
        # A day's rows come together in few files; a hot day is split.
        by_day = ledger.withColumn("merge", F.lit(merge)).hint("rebalance", "order_date")
        # Gathered while the days are written: reading them back would list every day of the store.
        by_day, gathered = observed(
            by_day,
            [
                F.coalesce(F.sum("rows_0"), F.lit(0)).alias("lines"),
                F.collect_set("order_date").alias("days"),
                F.count_if(F.col("order_date").isNull()).alias("undated"),
            ],
        )
        by_day.write.mode("append").partitionBy("order_date", "merge").parquet(f"{self._path}/days")
        done = gathered().first()
        days = [*done["days"], *([None] if done["undated"] else [])]
        new = self._spark.createDataFrame([(day, merge) for day in days], DAYS)
        old = self._list()
        same = F.col("old.order_date").eqNullSafe(F.col("new.order_date"))
        kept = old.alias("old").join(new.alias("new"), same, "left_anti")
        gone = old.alias("old").join(new.alias("new"), same, "left_semi").collect()
        with sinks.publication(self._spark, f"{self._path}/list") as aside:
            kept.unionByName(new).coalesce(1).write.parquet(aside)
        for row in gone:
            day = "__HIVE_DEFAULT_PARTITION__" if row["order_date"] is None else row["order_date"]
            delete(self._spark, f"{self._path}/days/order_date={day}/merge={row['merge']}")
        return Merged(done["lines"], len(days) - len(gone), len(gone))

    def ledger(self) -> DataFrame:
        """All days as one ledger, as ``order_ledger`` gives it for all lines at once."""
        listed = F.broadcast(self._list()).alias("list")  # a row per day
        ledger = self._written().alias("all")
        same = F.col("all.order_date").eqNullSafe(F.col("list.order_date")) & (F.col("all.merge") == F.col("list.merge"))
        return ledger.join(listed, same, "left_semi").drop("merge")

    def window(self) -> DayWindow:
        """From the first to the last day of the ledger."""
        ends = self._list().agg(F.min("order_date").alias("first"), F.max("order_date").alias("last")).first()
        if ends["first"] is None:
            raise ValueError("the ledger has no day")
        return DayWindow(ends["first"], ends["last"])

    def report(self, config: AnalysisConfig, source_file: str = "") -> GrowthReport:
        """The report over all days, without their lines."""
        return settled_report(self.ledger(), config, source_file)

    def _written(self) -> DataFrame:
        """All days that any merge has written, listed or not."""
        empty = order_ledger(self._spark.createDataFrame([], LINE_SCHEMA), self._rules)
        columns = [f for f in empty.schema if f.name != "order_date"]
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        target, store = file_of(self._spark, f"{self._path}/days")
        if not store.exists(target):
            return empty.withColumn("merge", F.lit(""))
        stored = self._spark.read.schema(f"{types}, {DAYS}").parquet(f"{self._path}/days")
        return stored.select(*empty.columns, "merge")

    def _list(self) -> DataFrame:
        sinks.recover(self._spark, f"{self._path}/list")
        target, store = file_of(self._spark, f"{self._path}/list")
        if not store.exists(target):
            return self._spark.createDataFrame([], DAYS)
        return self._spark.read.schema(DAYS).parquet(f"{self._path}/list")
