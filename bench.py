"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line.

Each query is built, planned and run in full into the no-op sink, twice; the second run counts, as
the first one mostly measures the JVM compiling its code.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tillwise.registry import queries  # noqa: E402
from tillwise.sources import Tables  # noqa: E402

HEADLINE = [
    "data_quality_steps",
    "daily_stats",
    "monthly_kpi_mom",
    "first_orders",
    "cohort_retention_long",
    "cohort_retention_matrix",
    "order_level",
    "guest_metrics",
    "outlier_sensitivity",
    "profile_raw",
    "profile_clean",
    "order_ledger",
    "insights",
    "dashboard_bundle",
    "ext_top_sku",
    "ext_guest_leads",
    "ext_repeat_vs_churn",
    "ext_country_kpi",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillwise-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tillwise-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        # Nothing that a query stages is there for the next run.
        with Tables(spark):
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in wanted:
        run(name)
    seconds = {name: round(run(name), 3) for name in wanted}
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
