"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: every task packs the documents it reads, in the order it reads them,
with a fixed number of open bins. Bins hang on a list per free space, and a bitset has bit f set when
some bin has f free tokens, so the tightest bin that still takes a piece is the lowest set bit at or
above the piece's length. When no open bin takes the piece and all are in use, the fullest one closes.

There is no shuffle. Each task holds one Arrow batch and at most ``open_bins`` bin numbers; what a
task leaves open at its end is the only space that more documents could have filled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.tokens import encoder

SEQUENCE_TOKENS = 1024
OPEN_BINS = 512
END_OF_TEXT = 2
#: Texts per Arrow piece that is tokenised at once; bounds a worker's memory together with their length.
ROWS_AT_ONCE = 64

PIECES = (
    "piece int, start long, length long, ids binary, sequence_id long, offset long"
)


class BestFit:
    """Open bins of ``capacity`` tokens, of which the fullest closes when too many are open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self._capacity, self._most = capacity, open_bins
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._bitset = 0
        self._open = 0
        self._made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin, numbered from 0, and the offset in it of a piece of 0 < length <= capacity tokens."""
        fitting = self._bitset >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self._open >= self._most:
                self._take((self._bitset & -self._bitset).bit_length() - 1)
            number, free = self._made, self._capacity
            self._made += 1
        if free > length:
            self._by_free[free - length].append(number)
            self._bitset |= 1 << (free - length)
            self._open += 1
        return number, self._capacity - free

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        number = bins.pop()
        if not bins:
            self._bitset &= ~(1 << free)
        self._open -= 1
        return number


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, after a first one that takes the remainder."""
    first = length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pack(
    documents: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS,
    open_bins: int = OPEN_BINS,
    end_id: int = END_OF_TEXT,
) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    A null text counts as empty; an empty document is one piece that holds the end id alone. A null id
    is carried along, repeated rows are packed once each, other columns are not read. An empty table
    gives no piece. ``vocabulary`` is a path that every executor can open.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "")
                    ids.append(end_id)
                    for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                        number, offset = bins.place(length)
                        rows.append((key, k, start, length, ids[start : start + length].tobytes(), base + number, offset))
                columns = [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema
                )

    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = chosen.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = pa.schema(
        [
            ("id", to_arrow_type(id_type)),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )
    packed = chosen.mapInArrow(run, f"id {id_type.simpleString()}, {PIECES}")
    return packed.withColumnRenamed("id", id_col)


def packing_digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return packed.select(
        id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
