"""A co-partitioned copy of the star: tables bucketed by the key that they are joined on.

``lineitem`` and ``orders`` are dealt by order key into the same number of buckets, a sorted file each, so
their join reads bucket by bucket and shuffles neither side. A layout is written once and joined as often as there are
queries on dates, customers or countries of lines. What the layout is keyed by is in the names of its folders, so any
session can open it by its path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from tillwise.session import MB, PIECE_BYTES
from tillwise.sources.lines import LINE_COLUMNS
from tillwise.sources.shared import file_of
from tillwise.sources.star import STAR_TABLES, lines_of_star

#: Tables of the layout that are bucketed, with their keys; the others are small beside these and are copied as they are.
BUCKETED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
#: Parquet bytes of one bucket. A bucket is sorted whole by one task as it is written and again as it is joined, and its rows take
#: more than ten times their Parquet bytes there, so that buckets of ``PIECE_BYTES`` would not fit into a task's memory and spill.
BUCKET_BYTES = 16 * MB
_FOLDER = re.compile(r"(?P<table>\w+)\.by\.(?P<key>\w+)\.(?P<buckets>\d+)$")


def bucket_count(input_bytes: int, piece_bytes: int = PIECE_BYTES) -> int:
    """Buckets of about one piece each for tables of this many bytes together."""
    return max(1, -(-input_bytes // piece_bytes))


def write_star_layout(spark: SparkSession, table: Callable[[str], DataFrame], path: str, buckets: int) -> None:
    """Writes the star's tables to a path, ``lineitem`` and ``orders`` in ``buckets`` buckets by order key.

    Each bucket is one file, as rows are dealt by the function that numbers the buckets before they are written.
    A hot order key fills one bucket; beside the others it is as large as its lines are.
    """
    for name in STAR_TABLES:
        frame = table(name)
        if name not in BUCKETED:
            frame.write.parquet(f"{path}/{name}")
            continue
        key = BUCKETED[name]
        catalog_name = _catalog_name(path, name)
        spark.sql(f"DROP TABLE IF EXISTS {catalog_name}")
        dealt = frame.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        dealt.option("path", f"{path}/{name}.by.{key}.{buckets}").format("parquet").saveAsTable(catalog_name)


def open_star_layout(spark: SparkSession, path: str) -> Callable[[str], DataFrame]:
    """The tables of a layout by name, for ``lines_of_star``."""
    target, store = file_of(spark, path)
    folders = [status.getPath() for status in store.listStatus(target) if status.isDirectory()]
    found: dict[str, DataFrame] = {}
    for folder in folders:
        location, bucketed = folder.toString(), _FOLDER.search(folder.getName())
        if not bucketed:
            found[folder.getName()] = spark.read.parquet(location)
            continue
        name, key, buckets = bucketed.groups()
        catalog_name = _catalog_name(path, name)
        if not spark.catalog.tableExists(catalog_name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(location).schema)
            spark.sql(
                f"CREATE TABLE {catalog_name} ({columns}) USING parquet "
                f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'"
            )
        found[name] = spark.table(catalog_name)
    return found.__getitem__


def close_star_layout(spark: SparkSession, path: str) -> None:
    """Takes a layout's tables out of the session's catalog; its files stay."""
    for name in BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(path, name)}")


def layout_lines(spark: SparkSession, path: str, columns: Iterable[str] = LINE_COLUMNS) -> DataFrame:
    """The line table over a layout."""
    return lines_of_star(open_star_layout(spark, path), columns)


def _catalog_name(path: str, name: str) -> str:
    return f"tillwise_{name}_{sha256(path.encode()).hexdigest()[:16]}"
