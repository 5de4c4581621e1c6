"""Benchmark passages in documents, found with a distributed positional inverted index.

The index is partitioned by documents. A segment covers a run of documents of bounded size and holds,
for each of their words, the sorted positions at which it occurs. Segments are rows of a table in the
shared folder, so the documents are read and split once, and every search reads that table alone.

A search takes the benchmark in blocks of bounded size. Within a segment a window's candidates are the
positions of its rarest word, moved back by that word's offset; the lists of its other words, moved
likewise and taken from rare to common, are intersected with them until no candidate is left. Most
windows end at once, as some word of theirs is missing from the segment. A candidate all of whose words
stand in their places is an exact phrase; one whose words all stand within ``slack`` of their places is
a proximity match, as a passage with a word added or left out gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillwise.sources.shared import stage

WINDOW_WORDS = 13
SLACK = 2
#: A document is contaminated when hits are at least one in so many of its words.
HIT_SHARE = 20
SEGMENT_WORDS = 1 << 17
BLOCK_CHARS = 1 << 21
ROWS_AT_ONCE = 256

# Words keep digits, a-z and everything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8. No byte of a character beyond ASCII looks like a separator."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _index(gap: int, segment_words: int, id_type: pa.DataType) -> tuple[object, pa.Schema]:
    """Documents (id, text) to segments; documents lie ``gap`` positions apart, so that no match spans two."""
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("ids", pa.list_(id_type)),
            ("n_words", pa.list_(pa.int64())),
            ("terms", pa.binary()),
            ("ends", pa.binary()),
            ("postings", pa.binary()),
        ]
    )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        coded: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        between = np.full(gap, -1, np.int32)
        held_words = 0

        def segment() -> pa.RecordBatch:
            nonlocal made, held_words
            flat = np.concatenate(coded)
            order = np.argsort(flat, kind="stable").astype("<i4")
            counts = np.bincount(flat[flat >= 0], minlength=len(numbers))
            row = {
                "segment": [made],
                "ids": [list(ids)],
                "n_words": [list(lengths)],
                "terms": [b" ".join(numbers)],
                "ends": [np.cumsum(counts).astype("<i4").tobytes()],
                "postings": [order[gap * len(ids) :].tobytes()],
            }
            made, held_words = made + 1, 0
            for held in (ids, lengths, coded, numbers):
                held.clear()
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = words(text)
                    for word in own:
                        if word not in numbers:
                            numbers[word] = len(numbers)
                    ids.append(key)
                    lengths.append(len(own))
                    coded += [np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)), between]
                    held_words += len(own) + gap
                    if held_words >= segment_words:
                        yield segment()
        if ids:
            yield segment()

    return build, schema


class _Windows:
    """The windows of a block of items, as numbers of the block's words, grouped by length."""

    def __init__(self, items: list[tuple], window: int) -> None:
        numbers: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, (_, text) in enumerate(items):
            own = np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.int64)
            if len(own):
                size = min(window, len(own))
                shown = np.lib.stride_tricks.sliding_window_view(own, size)
                by_length.setdefault(size, []).append((shown, np.full(len(shown), i)))
        self.terms = list(numbers)
        self.groups = [
            (np.concatenate([w for w, _ in of]), np.concatenate([i for _, i in of])) for of in by_length.values()
        ]


class Segment:
    """The positions of each word in a run of documents."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, n_words: list[int], gap: int) -> None:
        self._numbers = {t: i for i, t in enumerate(terms.split())}
        self._ends = np.concatenate([[0], np.frombuffer(ends, "<i4")])
        self._postings = np.frombuffer(postings, "<i4")
        self.starts = np.concatenate([[0], np.cumsum(np.array(n_words) + gap)[:-1]])

    def search(self, windows: _Windows, slack: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Item number, length, first positions, and whether each is an exact phrase, of windows that match."""
        found = np.array([self._numbers.get(t, -1) for t in windows.terms], np.int64)
        begin = np.where(found < 0, 0, self._ends[found])
        end = np.where(found < 0, 0, self._ends[found + 1])
        size = end - begin
        for shown, items in windows.groups:
            alive = np.flatnonzero(size[shown].min(axis=1) > 0)
            for w in alive:
                codes = shown[w]
                order = np.argsort(size[codes], kind="stable")
                rarest = order[0]
                places = self._postings[begin[codes[rarest]] : end[codes[rarest]]] - rarest
                exact = np.ones(len(places), bool)
                for k in order[1:]:
                    own = self._postings[begin[codes[k]] : end[codes[k]]]
                    near = np.searchsorted(own, places + k - slack)
                    close = own[np.minimum(near, len(own) - 1)]
                    keep = (near < len(own)) & (close <= places + k + slack)
                    places, exact = places[keep], exact[keep]
                    if not len(places):
                        break
                    there = np.searchsorted(own, places + k)
                    exact &= own[np.minimum(there, len(own) - 1)] == places + k
                if len(places):
                    yield int(items[w]), len(codes), places, exact


def _search(items: object, window: int, slack: int, gap: int) -> tuple[object, str]:
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("ordinal", pa.int32()),
            ("item", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("exact", pa.bool_()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(items.value, window)
        for batch in batches:
            for at in range(batch.num_rows):
                number, n_words, terms, ends, postings = (c[at].as_py() for c in batch.columns)
                segment = Segment(terms, ends, postings, n_words, gap)
                spans: dict[tuple[int, bool], list[tuple[np.ndarray, int]]] = {}
                for item, length, places, exact in segment.search(windows, slack):
                    for kind in (True, False):
                        if (exact == kind).any():
                            spans.setdefault((item, kind), []).append((places[exact == kind], length))
                for (item, kind), of in spans.items():
                    start = np.concatenate([p for p, _ in of])
                    stop = np.concatenate([p + n for p, n in of])
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    opens = np.concatenate([[True], start[1:] > stop[:-1]])
                    closes = np.concatenate([opens[1:], [True]])
                    first, last = start[opens], stop[closes]
                    ordinal = np.searchsorted(segment.starts, first + slack, side="right") - 1
                    start = np.maximum(first - segment.starts[ordinal], 0)
                    stop = np.minimum(last - segment.starts[ordinal], np.array(n_words)[ordinal])
                    columns = (
                        np.full(len(first), number),
                        ordinal.astype(np.int32),
                        np.full(len(first), item, np.int32),
                        start,
                        stop - start,
                        np.full(len(first), kind),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run, "segment long, ordinal int, item int, start long, length long, exact boolean"


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items (id, text) in blocks of at most so many characters, or of one item each."""
    total, most = benchmark.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, -(-(most or 0) // block_chars))
    block = lambda: F.pmod(F.xxhash64("id", "text"), F.lit(n))
    while n < total and (benchmark.groupBy(block().alias("b")).agg(F.sum(F.length("text")).alias("s")).agg(F.max("s")).first()[0] or 0) > block_chars:
        n *= 2
    for i in range(n):
        if rows := [(r[0], r[1]) for r in benchmark.filter(block() == i).select("id", "text").collect()]:
            yield rows


def benchmark_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    slack: int = SLACK,
    segment_words: int = SEGMENT_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Documents (segment, ordinal, id, n_words) and matches (segment, ordinal, item_id, start, length, exact).

    A match covers overlapping windows of one item in one document; start and length count words. An
    item of fewer words than a window is one window, an item without words has none. Null texts have no
    words; null ids and repeated rows of documents are documents of their own. Other columns are not read.
    Empty tables give no rows.
    """
    gap = window + 2 * slack + 1
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    build, _ = _index(gap, segment_words, to_arrow_type(id_type))
    segments = rows.mapInArrow(
        build,
        f"segment long, ids array<{id_type.simpleString()}>, n_words array<long>, terms binary, ends binary, postings binary",
    )
    segments = stage(segments, "postings")
    listed = segments.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "of")).select(
        "segment", "ordinal", F.col("of.ids").alias(id_col), F.col("of.n_words").alias("n_words")
    )
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_id_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.filter("text is not null").distinct()
    matches = None
    for block in _blocks(items, block_chars):
        run, ddl = _search(spark.sparkContext.broadcast(block), window, slack, gap)
        found = segments.select("segment", "n_words", "terms", "ends", "postings").mapInArrow(run, ddl)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], items.select(F.lit(0).alias("item"), "id").schema)
        found = found.join(F.broadcast(names), "item").select(
            "segment", "ordinal", F.col("id").alias("item_id"), "start", "length", "exact"
        )
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        ddl = f"segment long, ordinal int, item_id {items.schema['id'].dataType.simpleString()}, start long, length long, exact boolean"
        matches = spark.createDataFrame([], ddl)
    return listed, matches


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """One row per document: the id, n_words, n_hit, n_items, items, contaminated, n_near, segment, ordinal.

    ``n_hit`` counts words inside exact phrases, ``items`` lists the ids with exact phrases, sorted as
    strings, and ``n_near`` counts words inside proximity matches that are no exact phrase. Items whose id
    is null hit, but are not listed. See ``benchmark_matches`` for the options and for odd input.
    """
    listed, matches = benchmark_matches(documents, benchmark, id_col=id_col, **options)

    def covered(exact: bool) -> object:
        spans = F.array_sort(F.collect_list(F.when(F.col("exact") == exact, F.struct("start", (F.col("start") + F.col("length")).alias("stop")))))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 30)).cast("long").alias("stop"))
        return F.aggregate(
            spans,
            zero,
            lambda acc, x: F.struct(
                (acc["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["start"], acc["stop"]))).alias("n"),
                F.greatest(acc["stop"], x["stop"]).alias("stop"),
            ),
            lambda acc: acc["n"],
        )

    hits = matches.groupBy("segment", "ordinal").agg(
        covered(True).alias("n_hit"),
        covered(False).alias("n_near"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"),
    )
    whole = listed.join(hits, ["segment", "ordinal"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return whole.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "segment",
        "ordinal",
    )


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(id_col, "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated", "n_near")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents that are not contaminated, columns unchanged.

    Documents are told apart by their id and a hash of their words, on which alone the decision depends.
    """
    words_hash = F.xxhash64(F.translate(F.col(text_col).cast("string"), _UPPER, _UPPER.lower()))
    keyed = documents.select(F.struct(F.col(id_col).alias("id"), words_hash.alias("hash")).alias("_key"), F.col(text_col).alias("_text"))
    found = contamination(keyed, benchmark, id_col="_key", text_col="_text", **options)
    bad = stage(found.filter("contaminated").select("_key").distinct(), "contaminated")
    same = F.col("_id").eqNullSafe(F.col("_key.id")) & (F.col("_hash") == F.col("_key.hash"))
    rows = documents.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.coalesce(words_hash, F.lit(0)).alias("_hash"))
    return rows.join(bad, same, "left_anti").select("_row.*")
