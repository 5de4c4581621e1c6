"""Nested result documents.

Every array holds one element per funnel step, calendar month or cohort, so its length does not
grow with the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.rows import as_struct, records, side_by_side


def summary_document(
    raw_profile: DataFrame,
    clean_profile: DataFrame,
    step_records: DataFrame,
    note: DataFrame,
    headline: DataFrame,
    source_file: str,
) -> DataFrame:
    """One row: dataset, cleaned, data_quality, consistency_note, insights."""
    dataset = raw_profile.select(F.lit(source_file).alias("source_file"), *raw_profile.columns)
    return side_by_side(
        as_struct(dataset, "dataset"),
        as_struct(clean_profile, "cleaned"),
        step_records,
        as_struct(note, "consistency_note"),
        as_struct(headline, "insights"),
    )


def dashboard_bundle(
    summary: DataFrame, step_records: DataFrame, kpi: DataFrame, matrix: DataFrame, guests: DataFrame
) -> DataFrame:
    """One row: the summary and all report tables."""
    return side_by_side(
        as_struct(summary, "summary"),
        step_records,
        records(kpi, "monthly_kpi", "order_month"),
        records(matrix, "cohort_retention_matrix", "cohort_month"),
        records(guests, "guest_metrics", "order_month"),
    )


def to_json_text(document: DataFrame, pretty: bool = False) -> DataFrame:
    """A document as JSON text; NULL fields are kept as null, and NaN and infinity, which JSON lacks, are null."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    finite = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in document.schema]
    return document.select(F.to_json(F.struct(*finite), options).alias("json"))


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.StructType):
        parts = [_finite(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _finite(item, kind.elementType))
    return value


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document that was written with this schema, as one row; one that does not fit fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def document_values(document: DataFrame) -> DataFrame:
    """A document laid out as rows (path, text, number), one for each value, NULL ones too."""
    parts = [_values(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in document.schema]
    return document.select(F.inline(F.concat(*parts)))


def _values(value: Column, kind: T.DataType, path: Column) -> Column:
    if isinstance(kind, T.StructType):
        return F.concat(*[_values(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind])
    if isinstance(kind, T.ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.flatten(F.transform(value, lambda item, i: _values(item, kind.elementType, at(i))))
    is_text = isinstance(kind, T.StringType)
    text, number = (value, F.lit(None)) if is_text else (F.lit(None), value)
    return F.array(F.struct(path.alias("path"), text.cast("string").alias("text"), number.cast("double").alias("number")))
