"""Exact duplicates by a distributed content sort.

Spark samples splitters and range-partitions the rows by their normalised text, then sorts each range,
on disk where need be, so that equal texts lie side by side; each row is compared in full with its
neighbour. The range key is a bounded one (the first characters, a hash of the whole and the id), as
splitters pass through the driver. Its last part lets a text that a third of all rows share spread
over many ranges. Only the first and last run of equal texts of a range can go on in another range,
so these alone, two a range, are merged afterwards by their whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillwise.sources.shared import stage

#: White space that does not tell texts apart.
IGNORED = r"[\x20\x09-\x0D]+"
SPLITTER_CHARS = 32
ROWS_OUT = 5000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), IGNORED, "")


class _Run:
    """Rows with the same text in one range."""

    def __init__(self, text: str, sha: str) -> None:
        self.text, self.sha, self.ids, self.sizes = text, sha, [], []

    def rows(self, range_no: int, side: int | None) -> Iterator[tuple]:
        """Decisions within this range; the first row of a run that may go on elsewhere carries its text."""
        order = lambda i: (-self.sizes[i], self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0, i)
        best = min(range(len(self.ids)), key=order)
        keep, chars = self.ids[best], self.sizes[best]
        repeats = sum(i == keep and n == chars for i, n in zip(self.ids, self.sizes, strict=True))
        for i, key in enumerate(self.ids):
            text = self.text if side is not None and i == 0 else None
            yield key, self.sha, keep, len(self.ids), i == best, chars, repeats, range_no, side, text


def _runs(id_type: pa.DataType) -> tuple[object, pa.Schema]:
    schema = pa.schema(
        [
            ("id", id_type),
            ("text_sha256", pa.string()),
            ("keep_id", id_type),
            ("group_size", pa.int64()),
            ("kept", pa.bool_()),
            ("keep_chars", pa.int64()),
            ("repeats", pa.int64()),
            ("range_no", pa.int32()),
            ("side", pa.int32()),
            ("edge_text", pa.string()),
        ]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_no, run, first, out = TaskContext.get().partitionId(), None, True, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for key, chars, sha, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run is None or text != run.text:
                    if run is not None:
                        out.extend(run.rows(range_no, 0 if first else None))
                        first = False
                    run = _Run(text, sha)
                run.ids.append(key)
                run.sizes.append(chars)
                while len(out) >= ROWS_OUT:
                    yield made(out[:ROWS_OUT])
                    del out[:ROWS_OUT]
        if run is not None:
            out.extend(run.rows(range_no, 0 if first else 1))
        for at in range(0, len(out), ROWS_OUT):
            yield made(out[at : at + ROWS_OUT])

    return scan, schema


def exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept, text_sha256, keep_chars, repeats.

    Texts are equal when they are so without white space. The row with the most code points stays, then
    the one with the smallest id (a null id comes last); of rows that tie in both, one has ``kept``, and
    ``repeats`` counts them. Null texts count as empty, and empty texts are one group. Other columns are
    not read. An empty table gives no row.
    """
    text = F.col(text_col).cast("string")
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"),
        normalised(text).alias("norm"),
    ).select("*", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("norm").alias("hash"))
    placed = rows.repartitionByRange("head", "hash", "id").sortWithinPartitions("head", "hash", "norm", "id")
    scan, schema = _runs(to_arrow_type(rows.schema["id"].dataType))
    id_ddl = rows.schema["id"].dataType.simpleString()
    found = placed.select("id", "chars", F.sha2("norm", 256).alias("sha"), "norm").mapInArrow(
        scan,
        f"id {id_ddl}, text_sha256 string, keep_id {id_ddl}, group_size long, kept boolean, keep_chars long, "
        "repeats long, range_no int, side int, edge_text string",
    )
    found = stage(found, "exact_runs")

    same = Window.partitionBy("edge_text")
    best_first = same.orderBy(F.desc("keep_chars"), F.asc_nulls_last("keep_id"), "range_no", "side")
    edges = (
        found.filter("edge_text is not null")
        .select(
            "range_no",
            "side",
            F.sum("group_size").over(same).alias("whole_size"),
            F.first("keep_id").over(best_first).alias("best_id"),
            F.first("keep_chars").over(best_first).alias("best_chars"),
            (F.row_number().over(best_first) == 1).alias("is_best"),
            "keep_id",
            "keep_chars",
            "repeats",
            "edge_text",
        )
        .select(
            "range_no",
            "side",
            "whole_size",
            "best_id",
            "best_chars",
            "is_best",
            F.sum(
                F.when(F.col("keep_id").eqNullSafe(F.col("best_id")) & (F.col("keep_chars") == F.col("best_chars")), F.col("repeats"))
            )
            .over(same)
            .alias("whole_repeats"),
        )
    )
    columns = ["keep_id", "group_size", "kept", "text_sha256", "keep_chars", "repeats"]
    inside = found.filter("side is null").select(F.col("id").alias(id_col), *columns)
    across = (
        found.filter("side is not null")
        .join(edges, ["range_no", "side"])
        .select(
            F.col("id").alias(id_col),
            F.col("best_id").alias("keep_id"),
            F.col("whole_size").alias("group_size"),
            (F.col("kept") & F.col("is_best")).alias("kept"),
            "text_sha256",
            F.col("best_chars").alias("keep_chars"),
            F.col("whole_repeats").alias("repeats"),
        )
    )
    return inside.unionByName(across)


def drop_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, columns unchanged; of rows that repeat in id and text, one stays."""
    decided = stage(exact_duplicates(documents, id_col=id_col, text_col=text_col), "exact_decided")
    kept = decided.filter("kept").select(
        F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"), F.col("keep_chars").alias("_keep_chars"), "repeats"
    )
    text = F.col(text_col).cast("string")
    marked = documents.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.sha2(normalised(text), 256).alias("_sha"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_chars"),
    )

    def matching(some: DataFrame) -> DataFrame:
        here = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha"))
        return marked.join(some.drop("repeats"), here & (F.col("_chars") == F.col("_keep_chars")), "left_semi")

    out = matching(kept.filter("repeats = 1"))
    repeated = kept.filter("repeats > 1")
    if not repeated.isEmpty():
        out = out.unionByName(matching(repeated).dropDuplicates(["_sha"]))
    return out.select("_row.*")
