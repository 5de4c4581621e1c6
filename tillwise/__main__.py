"""Full report from the command line: python -m tillwise LINES OUT [--format F] [--first-day D --last-day D] [--ledger STORE]."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.config import AnalysisConfig, CleaningRules, DayWindow, InsightMonths
from tillwise.plans.daily import LedgerStore
from tillwise.plans.growth import growth_report
from tillwise.session import apply_settings
from tillwise.sources import read_csv, read_parquet, read_table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tillwise", description=__doc__)
    parser.add_argument("lines", help="CSV or Parquet file or folder, or the name of a catalog table")
    parser.add_argument("out", help="folder for the five CSV tables and the two JSON documents")
    parser.add_argument("--format", choices=["csv", "parquet", "table"], help="of the lines; told by the name if left out")
    parser.add_argument("--first-day", type=date.fromisoformat, help="of the analysis; the first day with a line if left out")
    parser.add_argument("--last-day", type=date.fromisoformat, help="of the analysis; the last day with a line if left out")
    parser.add_argument("--timestamp-format", default="yyyy-MM-dd HH:mm:ss", help="of InvoiceDate in CSV")
    parser.add_argument("--input-gb", type=float, help="size of the lines; sets scan and shuffle sizes to match")
    parser.add_argument("--ledger", help="folder of a ledger by days; LINES are merged into it and the report covers all its days")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tillwise").getOrCreate()
    if args.input_gb is not None:
        apply_settings(spark, int(args.input_gb * 2**30))
    kind = args.format or format_of(args.lines)
    if kind == "csv":
        lines = read_csv(spark, args.lines, timestamp_format=args.timestamp_format)
    else:
        lines = read_parquet(spark, args.lines) if kind == "parquet" else read_table(spark, args.lines)
    source_file = args.lines.rstrip("/").rsplit("/", 1)[-1]
    if args.ledger:
        store = LedgerStore(spark, args.ledger, CleaningRules())
        merged = store.merge(lines)
        print(f"{merged.lines} lines read, {merged.added} days added, {merged.replaced} days replaced")
        known = store.window()
        window = DayWindow(args.first_day or known.start, args.last_day or known.end)
    else:
        window = observed_window(lines, args.first_day, args.last_day)
    config = AnalysisConfig(window=window, months=InsightMonths.of(window))
    report = store.report(config, source_file) if args.ledger else growth_report(lines, config, source_file)
    report.write(args.out)
    print(spark.read.text(f"{args.out}/analysis_summary.json", wholetext=True).first()[0])


def format_of(name: str) -> str:
    """csv or parquet by the ending, before that of a compression; else a path is Parquet and a bare name a table."""
    parts = name.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    for ending in parts[-1:0:-1]:
        if ending in ("csv", "parquet"):
            return ending
        if ending not in ("gz", "bz2", "zst", "lz4", "snappy"):
            break
    return "parquet" if "/" in name else "table"


def observed_window(lines: DataFrame, first: date | None, last: date | None) -> DayWindow:
    """The given days, and the first or last day with a line where one is not given."""
    if first is None or last is None:
        seen = lines.agg(F.min(F.to_date("InvoiceDate")).alias("first"), F.max(F.to_date("InvoiceDate")).alias("last")).first()
        if seen["first"] is None:
            raise SystemExit("the lines have no day; give --first-day and --last-day")
        first, last = first or seen["first"], last or seen["last"]
    return DayWindow(first, last)


if __name__ == "__main__":
    main()
