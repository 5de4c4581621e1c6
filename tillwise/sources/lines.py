"""The eight-column transaction-line table and its readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.fixed_values import MISSING_VALUES

# One row is one product line of an invoice. Prices keep four decimals (some are below a cent).
PRICE_TYPE = T.DecimalType(14, 4)

LINE_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", PRICE_TYPE),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)
LINE_COLUMNS = LINE_SCHEMA.fieldNames()

_TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in LINE_SCHEMA])
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    timestamp_format: str = TIMESTAMP_FORMAT,
    null_values: Sequence[str] = MISSING_VALUES,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Lines from CSV files or folders, plain or compressed; a value that does not parse fails the read.

    A field that equals one of ``null_values`` is NULL. ``multi_line`` allows line breaks inside quotes, at
    the price of one task per file.
    """
    raw = (
        spark.read.schema(_TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .csv(path)
    )
    return conform(_without_markers(raw, null_values), timestamp_format)


def lines_of_csv_text(
    rows: DataFrame,
    column: str,
    *,
    timestamp_format: str = TIMESTAMP_FORMAT,
    null_values: Sequence[str] = MISSING_VALUES,
) -> DataFrame:
    """Lines from a column that holds one CSV record per row, under the rules of ``read_csv``."""
    ddl = ", ".join(f"{f.name} string" for f in _TEXT_SCHEMA)
    parsed = F.from_csv(F.col(column), ddl, {"mode": "FAILFAST", "escape": '"'})
    return conform(_without_markers(rows.select(parsed.alias("line")).select("line.*"), null_values), timestamp_format)


def _without_markers(raw: DataFrame, null_values: Sequence[str]) -> DataFrame:
    return raw.select(*[F.when(~F.col(c).isin(*null_values), F.col(c)).alias(c) for c in raw.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Lines from a catalog table or view."""
    return conform(spark.table(name))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lines from a Parquet file or folder."""
    return conform(spark.read.parquet(path))


def conform(frame: DataFrame, timestamp_format: str = TIMESTAMP_FORMAT) -> DataFrame:
    """The eight columns in order and in their types; columns that already fit are left bare.

    NaN is NULL. A value that its type cannot hold fails the query, whatever the session's ANSI mode.
    """
    have = {f.name: f.dataType for f in frame.schema}
    missing = [c for c in LINE_COLUMNS if c not in have]
    if missing:
        raise ValueError(f"transaction lines lack the columns {missing}")
    return frame.select(
        *[
            F.col(f.name) if have[f.name] == f.dataType else _strict(f, have[f.name], timestamp_format).alias(f.name)
            for f in LINE_SCHEMA
        ]
    )


def _strict(field: T.StructField, have: T.DataType, timestamp_format: str) -> Column:
    """The column in its type; the id may be written as a float ("17850.0"), as the column holds blanks."""
    value = F.col(field.name)
    if isinstance(have, T.FloatType | T.DoubleType):
        value = F.when(~F.isnan(value), value)
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(have, T.StringType):
        # NULL without ANSI mode; with it, this raises by itself.
        cast = F.to_timestamp_ntz(value, F.lit(timestamp_format))
    elif isinstance(field.dataType, T.LongType | T.IntegerType) and not isinstance(have, T.IntegralType):
        number = value.try_cast(T.DecimalType(38, 6))
        cast = F.when(number == F.floor(number), number.try_cast(field.dataType))
    else:
        cast = value.try_cast(field.dataType)
    lost = F.concat(F.lit(f"{field.name} cannot hold "), value.cast("string"))
    return F.when(value.isNotNull() & cast.isNull(), F.raise_error(lost)).otherwise(cast)
