"""Phrase collocation mining: phrases whose parts rarely stand apart.

Two passes over the texts. The first gives every task a hash for each run of one to four words, counts equal
hashes in the task and deals the counts to hash partitions. Each partition merges them into one Misra-Gries
summary whose capacity exceeds the partition's mass divided by the threshold, so that the hash of every
phrase with that many occurrences survives. The second pass counts the words of the surviving hashes
exactly, as text; a phrase that survived by a collision or by the summary's error is counted and dropped.

A summary never gives up a frequent phrase, whatever the estimate of the mass: it subtracts only while the sum of all
its subtractions stays below the threshold, and grows beyond that. Survivors reach the second pass as a
bitmap over the hash space of at most ``MOST_BITS`` bits. With more survivors than that the bitmap lets more other
phrases through to be counted, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.sources.shared import Tables, stage

#: Words of the longest phrase.
MOST_WORDS = 4
THRESHOLD = 30
#: A phrase goes when a longer one around it has at least this many hundredths of its occurrences.
COVERED_PERCENT = 80
TOP = 2000
SCORE_SCALE = 1_000_000
UNKNOWN_LANG = "und"

#: Bytes of text that a task splits into words at once, words that it counts at once, and words it remembers.
SLAB_BYTES = 1 << 20
WORDS_AT_ONCE = 1 << 20
MOST_KNOWN_WORDS = 400_000
#: Runs of one hash partition, as far as the number of partitions is free.
PARTITION_MASS = 1 << 24
#: Capacity of a summary, times its mass by the threshold. More than 1, so that less has to be subtracted.
CAPACITY_FACTOR = 4
#: Bits of a hash beyond those that number the runs: one run in 2^SPARE_BITS collides.
SPARE_BITS = 8
MOST_BITS = 1 << 28
BITS_PER_SURVIVOR = 16
#: Parts of a language in the first step of the ranking.
RANK_PARTS = 64

_BREAK = b"\n"
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(
    ord(_BREAK) if b in _SEPARATORS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_COUNTED = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with a line feed for every break between pieces, in slabs of bounded size."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at, size = 0, len(folded)
    while at < size:
        end = at + SLAB_BYTES
        if end < size:
            cut = folded.rfind(b" ", at, end)
            end = cut if cut > at else folded.find(b" ", end)
            end = size if end < 0 else end
        yield [w for w in folded[at:end].replace(_BREAK, b" \n ").split(b" ") if w]
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the upper ones."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


class Vocabulary:
    """Numbers of the words that a task has met; 0 is a break. It starts anew between two counts when it has grown too large."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self._codes, self.names, self._hashes = {_BREAK: 0}, [_BREAK], [0]

    def tidy(self) -> None:
        if len(self.names) > MOST_KNOWN_WORDS:
            self.forget()

    def codes(self, words: list[bytes]) -> np.ndarray:
        known, names, hashes = self._codes, self.names, self._hashes
        codes = [known.get(w, -1) for w in words]
        if min(codes, default=0) < 0:
            for i, w in enumerate(words):
                if codes[i] < 0:
                    code = known.get(w)
                    if code is None:
                        code = known[w] = len(names)
                        names.append(w)
                        hashes.append(xxhash.xxh64_intdigest(w))
                    codes[i] = code
        return np.array(codes, np.uint32)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self._hashes, np.uint64)[codes]


class Runs:
    """Words of one language in order, and the runs of them that are still to be counted.

    A run counts where its last word is added; the last words before that are kept as context, so neither
    slabs nor counts in between cut a run.
    """

    def __init__(self, lang: str) -> None:
        self._seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
        self._context = [_BREAK]
        self._new: list[bytes] = []

    def add(self, words: list[bytes]) -> None:
        self._new += words

    def take(self, vocabulary: Vocabulary) -> tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of new words, codes of all words, context first, and per length the hashes of its runs and where they end."""
        words, first_new = self._context + self._new, len(self._context)
        codes = vocabulary.codes(words)
        real, of_word = codes != 0, vocabulary.hashes(codes)
        runs, whole, hashed = [], real, _mixed(of_word ^ self._seed)
        for n in range(1, MOST_WORDS + 1):
            if n > 1:
                whole = whole[:-1] & real[n - 1 :]
                hashed = _mixed(hashed[:-1] * np.uint64(0x2545F4914F6CDD1D) + of_word[n - 1 :])
            ends = np.arange(n - 1, len(codes))
            wanted = whole & (ends >= first_new)
            runs.append((hashed[wanted], ends[wanted]))
        self._context, self._new = words[1 - MOST_WORDS :], []
        return int(real[first_new:].sum()), codes, runs


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, from the lowest up to the highest that any of them needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


class MisraGries:
    """A mergeable summary of weighted keys that keeps every key of ``threshold`` occurrences or more.

    Beyond its capacity it subtracts the count of the first key too many from all. A key has lost at most
    the sum of all subtractions, ``error``, which stays below the threshold: with a capacity above the mass by the
    threshold it cannot reach it, and where the mass was set too low the capacity doubles instead.
    """

    def __init__(self, capacity: int, threshold: int) -> None:
        self.capacity, self.threshold, self.error = max(1, capacity), threshold, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > self.capacity:
            self._merge()

    def _merge(self) -> None:
        parts = [(self.keys, self.counts), *self._waiting]
        self.keys, self.counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self._waiting, self._size = [], 0
        while len(self.keys) > self.capacity:
            place = len(self.keys) - self.capacity - 1
            least = int(np.partition(self.counts, place)[place])
            if self.error + least >= self.threshold:
                self.capacity *= 2
                continue
            self.error += least
            kept = self.counts > least
            self.keys, self.counts = self.keys[kept], self.counts[kept] - least

    def survivors(self) -> np.ndarray:
        """The keys that may have ``threshold`` occurrences, in order."""
        self._merge()
        return self.keys[self.counts + self.error >= self.threshold]


def _by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Runs]]:
    """The languages of the texts with their words, each time that enough words have come together, and at the end."""
    runs: dict[str, Runs] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            own = runs.setdefault(name, Runs(name))
            for words in words_of(text.as_py()):
                own.add(words)
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield from runs.items()
                    # The others end with a whole text, so that no run goes on in them.
                    runs, held = {name: own}, 0
            own.add([_BREAK])
    yield from runs.items()


def _summaries(texts: DataFrame, mass: int, threshold: int) -> DataFrame:
    """(keys, n): hashes that may belong to frequent phrases, in order, a row per hash partition; staged."""
    spark = texts.sparkSession
    bits = min(64, max(16, mass.bit_length() + SPARE_BITS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // PARTITION_MASS))
    part_bits = min(bits - 1, 24, (parts - 1).bit_length())
    capacity = CAPACITY_FACTOR * (mass // (threshold << part_bits) + 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, low = np.uint64(64 - bits), np.uint64(bits - part_bits)
        waiting: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hashed = np.sort(np.concatenate(waiting) >> drop)
            waiting.clear()
            heads = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]]) if len(hashed) else np.empty(0, np.int64)
            keys, counts = hashed[heads], np.diff(np.r_[heads, len(hashed)])
            of_part = (keys >> low).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, of_part[1:] != of_part[:-1], True]) if len(keys) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # Differences between hashes in order take half the bytes of hashes.
                gaps = np.diff(keys[a:b], prepend=np.uint64(of_part[a]) << low)
                rows.append((int(of_part[a]), int(b - a), _packed(gaps), _packed(counts[a:b])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED)

        held, vocabulary = 0, Vocabulary()
        for _, runs in _by_lang(batches):
            _, _, found = runs.take(vocabulary)
            vocabulary.tidy()
            waiting += [hashes for hashes, _ in found]
            held += sum(len(hashes) for hashes, _ in found)
            if held >= MOST_WORDS * WORDS_AT_ONCE // 2:
                yield from flush()
                held = 0
        if waiting:
            yield from flush()

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(bits - part_bits)
        part, summary = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                keys = summary.survivors()
                data = keys.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([data], pa.binary())], ["part", "n", "keys"])

        for batch in batches:
            for of, n, gaps, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != part:
                    yield from done()
                    part, summary = of, MisraGries(capacity, threshold)
                keys = np.cumsum(_unpacked(gaps, n), dtype=np.uint64) + (np.uint64(of) << low)
                summary.add(keys, _unpacked(counts, n).astype(np.int64))
        yield from done()

    counted = texts.mapInArrow(count, "part int, n long, keys binary, counts binary")
    dealt = counted.repartition(1 << part_bits, "part").sortWithinPartitions("part")
    return stage(dealt.mapInArrow(summarise, "part int, n long, keys binary"), "frequent_hashes")


class Bitmap:
    """Which stretches of the hash space hold survivors."""

    def __init__(self, bits: int, shift: int, data: np.ndarray) -> None:
        self.bits, self._shift, self._data = bits, shift, data

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        place = hashed >> np.uint64(self._shift)
        return (self._data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(survivors: DataFrame, mass: int) -> Bitmap:
    """The bitmap of the survivors, put together from one stretch per hash partition.

    Its size follows their number up to ``MOST_BITS``; each task sends the bytes that it sets.
    """
    bits = min(64, max(16, mass.bit_length() + SPARE_BITS))
    n = survivors.agg(F.sum("n")).first()[0] or 0
    wide = min(bits, MOST_BITS.bit_length() - 1, max(10, (BITS_PER_SURVIVOR * n).bit_length()))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                places = np.frombuffer(data, "<u8") >> np.uint64(bits - wide)
                if len(places):
                    first = int(places[0]) >> 3
                    own = np.zeros((int(places[-1]) >> 3) - first + 1, np.uint8)
                    np.bitwise_or.at(own, (places >> np.uint64(3)).astype(np.int64) - first, np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["first", "bytes"])

    whole = np.zeros(max(1, (1 << wide) >> 3), np.uint8)
    for row in survivors.select("keys").mapInArrow(mark, "first long, bytes binary").toLocalIterator():
        own = np.frombuffer(row["bytes"], np.uint8)
        whole[row["first"] : row["first"] + len(own)] |= own
    return Bitmap(wide, 64 - wide, whole)


def _exact_counts(texts: DataFrame, bitmap: Bitmap, threshold: int) -> DataFrame:
    """(lang, words, phrase, f): exact counts of the phrases that reach the threshold, and of all words under a null phrase."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, vocabulary = shared.value, Vocabulary()
        for lang, runs in _by_lang(batches):
            n_words, codes, found = runs.take(vocabulary)
            names = vocabulary.names
            out = [[0], [None], [n_words]]
            for n, (hashed, ends) in enumerate(found, start=1):
                ends = ends[marked.holds(hashed)]
                # A run as one number of up to 128 bits: two words in each of two columns.
                own = [codes[ends - (n - 1 - i)].astype(np.uint64) for i in range(n)]
                low = own[0] if n == 1 else (own[-2] << np.uint64(32)) | own[-1]
                high = None if n < 3 else own[0] if n == 3 else (own[0] << np.uint64(32)) | own[1]
                order = np.argsort(low) if high is None else np.lexsort((low, high))
                low = low[order]
                new = np.r_[True, low[1:] != low[:-1]] if len(low) else np.empty(0, bool)
                if high is not None and len(low):
                    high = high[order]
                    new[1:] |= high[1:] != high[:-1]
                heads = np.flatnonzero(new)
                at = ends[order[heads]]
                shown = [codes[at - (n - 1 - i)].tolist() for i in range(n)]
                out[0] += [n] * len(heads)
                out[1] += [b" ".join([names[c] for c in run]) for run in zip(*shown, strict=True)]
                out[2] += np.diff(np.r_[heads, len(low)]).tolist()
            vocabulary.tidy()
            text = pa.array(out[1], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.int32()), text, pa.array(out[2], pa.int64())], schema=schema)

    counted = texts.mapInArrow(count, "lang string, words int, phrase string, f long")
    summed = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return summed.filter((F.col("f") >= threshold) | F.col("phrase").isNull())


def phrase_counts(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD) -> DataFrame:
    """(lang, words, phrase, f): every phrase of one to four words with at least ``threshold`` occurrences in its language.

    Rows with a null phrase hold the number of all words of a language. A null text is empty, a null language
    is ``und``; repeated rows count each time; other columns are not read. The counts are staged.
    """
    texts = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter("text is not null")
    # No run has fewer than two bytes, its last word and what parts it from the next, and at most four runs end at a word.
    mass = MOST_WORDS * ((texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // 2 + 1)
    with Tables(documents.sparkSession) as tables:
        bitmap = _bitmap(_summaries(texts, mass, threshold), mass)
        return tables.hand_over(_exact_counts(texts, bitmap, threshold), "phrase_counts")


def _words(first: Column | int, n: Column) -> Column:
    """Words of a phrase as a phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(counts: DataFrame, *, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score): phrases of two words and more at their weakest cut.

    ``counts`` are those of ``phrase_counts``. A cut gives ``2,000,000 * a / (l + r)``, rounded down, of the counts of the phrase
    and its two parts; the least counts, and among equal ones that after the fewest words. A phrase is left out
    when its words stand in a longer frequent one that has ``covered_percent`` of its occurrences.
    """
    phrases = counts.filter("phrase is not null").select("lang", "words", "phrase", F.col("f").cast("decimal(20,0)").alias("f"))
    candidates = phrases.filter("words >= 2")
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part")).filter(f"words < {MOST_WORDS}")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "f", "k", _words(1, F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    with_l = sides.join(parts.withColumnsRenamed({"part": "first", "of_part": "l"}), ["lang", "first"])
    with_r = with_l.join(parts.withColumnsRenamed({"part": "rest", "of_part": "r"}), ["lang", "rest"])
    score = F.expr(f"({2 * SCORE_SCALE} * f) div (l + r)")
    weakest = with_r.groupBy("lang", "phrase", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = candidates.filter("words > 2").select("lang", "phrase", "words", F.col("f").alias("of_longer"))
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    starts = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = starts.select("lang", _words(F.col("start"), F.col("size")).alias("phrase"), "of_longer")
    around = inner.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    covered = 100 * F.coalesce("of_longer", F.lit(0)) >= covered_percent * F.col("f")
    left = weakest.join(around, ["lang", "phrase"], "left").filter(~covered)
    number = lambda c: F.col(c).cast("long")
    return left.select(
        "lang", "phrase", number("f").alias("a"), number("cut.l").alias("l"), number("cut.r").alias("r"), F.col("cut.score").alias("score")
    )


def top_collocations(found: DataFrame, counts: DataFrame, k: int = TOP) -> DataFrame:
    """The first k of each language by score, count and phrase, with their rank and the language's number of words.

    Each part of a language is ranked by itself first, so that the last step sees k rows of each part.
    """
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    first = found.withColumn("part", part).withColumn("rank", in_part).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= k)
    words = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
