"""License notices in documents, retrieved by MinHash bands and verified by shingle containment.

Templates of about one length form a class. A document's words are cut into overlapping windows for each class, which leave
room for words that were inserted into a notice: every stretch of up to n + ``WindowClass.allowance`` words lies whole in one
window, wherever it stands, n being the template's words. Windows and templates with an equal band of MinHash values meet in a join; a pair
counts when the window contains at least ``CONTAINMENT`` of the template's shingles. The number of bands follows from the
similarity that such a window has at least, and from the wanted probability of an equal band. A notice stretched further than
the allowance may still be found, but no window is bound to hold it.

Only windows with an anchor word of their class are hashed. The anchors of a template are the longest of its words, taken until
fewer than the required share of its shingles have none, so no match lacks one. Long texts are cut into chunks of words that
overlap by the longest window, so no step holds more than a chunk's windows.

Everything is done by DataFrame functions, and documents are not shuffled.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.notices import NOTICES
from tillwise.sources.shared import stage

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Hashes per band. One takes the fewest hashes for the wanted probability; what it retrieves needlessly shares a shingle at least.
BAND_ROWS = 1
FOUND_CHANCE = 0.9999
#: Up to so many words, every length is a class: one lost shingle is one too many, so nothing can be inserted.
SHORT_WORDS = 8
LEAST_ALLOWANCE = 8
#: Words of a chunk, without the overlap.
CHUNK_WORDS = 4096
#: Templates are broadcast; those of one part have so many words together, or are a single one.
PART_WORDS = 200_000

_BREAK = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingle_list(words: list[str]) -> list[str]:
    """All runs of five words; the whole text when it is shorter."""
    return [" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))]


def anchors(words: list[str]) -> set[str]:
    """Words of which every sufficiently contained version of the template has one."""
    shingles, chosen = sorted(set(shingle_list(words))), set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        bare = sum(chosen.isdisjoint(s.split(" ")) for s in shingles)
        if bare < CONTAINMENT * len(shingles):
            break
        chosen.add(word)
    return chosen


@dataclass(frozen=True)
class WindowClass:
    """Windows for templates of at most ``words`` words, and of more than the next smaller class has."""

    words: int

    @classmethod
    def of(cls, words: int) -> WindowClass:
        """The class of a template: classes grow by a quarter beyond the short ones."""
        size = SHORT_WORDS
        while size < words:
            size = size * 5 // 4
        return cls(size if words > SHORT_WORDS else words)

    @property
    def stride(self) -> int:
        return max(1, self.words // 4)

    @property
    def allowance(self) -> int:
        """Words that may be inserted into a notice."""
        return max(LEAST_ALLOWANCE, self.words // 4) if self.words > SHORT_WORDS else 0

    @property
    def length(self) -> int:
        return self.words + self.allowance + self.stride - 1

    def bands_for(self, shingles: int) -> int:
        """So many that a window with the least sufficient overlap with a template of so many shingles shares a band with
        the wanted probability."""
        wide, shared = max(1, self.length - SHINGLE_WORDS + 1), math.ceil(CONTAINMENT * shingles)
        alike = shared / (shingles + wide - shared)
        return 1 if alike >= 1 else math.ceil(math.log(1 - FOUND_CHANCE) / math.log(1 - alike**BAND_ROWS))

    @property
    def bands(self) -> int:
        """Enough for a template of ``words`` words without repeated shingles."""
        return self.bands_for(max(1, self.words - SHINGLE_WORDS + 1))


@dataclass(frozen=True)
class Part:
    """Templates that are scanned for together: their windows, and what is broadcast of them."""

    templates: dict[str, list[str]]

    @property
    def classes(self) -> dict[WindowClass, dict[str, list[str]]]:
        found: dict[WindowClass, dict[str, list[str]]] = {}
        for name, words in self.templates.items():
            found.setdefault(WindowClass.of(len(words)), {})[name] = words
        return found

    @staticmethod
    def bands(size: WindowClass, templates: dict[str, list[str]]) -> int:
        """Enough for every template of a class."""
        return max(size.bands_for(len(set(shingle_list(words)))) for words in templates.values())

    def windows(self) -> Column:
        """The classes as an array of structs."""
        found = []
        for size, templates in self.classes.items():
            own = sorted(set().union(*map(anchors, templates.values())))
            values = {"class": size.words, "stride": size.stride, "length": size.length, "bands": self.bands(size, templates)}
            found.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()], F.array(*map(F.lit, own)).alias("anchors")))
        return F.array(*found)

    def known(self, spark: SparkSession) -> DataFrame:
        """(class, license, asked, bands) of each template; ``asked`` are its shingles. One literal, so no Python worker reads it."""
        rows = [
            {"class": size.words, "license": name, "asked": sorted(set(shingle_list(words))), "bands": self.bands(size, templates)}
            for size, templates in self.classes.items()
            for name, words in templates.items()
        ]
        ddl = "array<struct<class: int, license: string, asked: array<string>, bands: int>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), ddl)))


def parts_of(templates: dict[str, list[str]], most_words: int = PART_WORDS) -> list[Part]:
    """The templates in parts of at most so many words."""
    found: list[dict[str, list[str]]] = []
    total = 0
    for name, words in templates.items():
        if not found or total + len(words) > most_words:
            found.append({})
            total = 0
        found[-1][name] = words
        total += len(words)
    return [Part(own) for own in found]


def document_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAK, -1), lambda w: w != "")


def _shingles(words: Column) -> Column:
    last = F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, SHINGLE_WORDS), " "))


def _bands(hashes: Column, bands: Column) -> Column:
    """The keys of the MinHash bands of a set of hashes."""

    def least(k: Column) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))

    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(b, *[least(b * BAND_ROWS + r) for r in range(BAND_ROWS)]))


def _starts(chunk: Column, hits: Column, size: Column) -> Column:
    """Where the windows of a class start, in words of the text, that start in a chunk and hold an anchor of the class.

    ``hits`` are the chunk's anchor words with their places in the text.
    """
    own = F.filter(hits, lambda h: F.array_contains(size["anchors"], h["word"]))
    stride, length = size["stride"], size["length"]

    def around(hit: Column) -> Column:
        first = F.greatest(F.ceil((hit["place"] - (length - 1)) / stride), F.lit(0))
        return F.sequence(first, F.floor(hit["place"] / stride))

    starts = F.transform(F.array_distinct(F.flatten(F.transform(own, around))), lambda no: (no * stride).cast("int"))
    return F.filter(starts, lambda at: (at >= chunk * CHUNK_WORDS) & (at < (chunk + 1) * CHUNK_WORDS))


def _anchored(rows: DataFrame, wanted: list[str], overlap: int) -> DataFrame:
    """(id, text_hash, chunk, words, hits): the chunks of texts (id, text) that hold an anchor word."""

    def chunk(n: Column, words: Column) -> Column:
        return F.struct(n.alias("chunk"), F.slice(words, n * CHUNK_WORDS + 1, CHUNK_WORDS + overlap).alias("words"))

    split = rows.select("id", F.xxhash64("text").alias("text_hash"), document_words(F.col("text")).alias("whole"))
    with_any = split.filter(F.exists("whole", lambda w: w.isin(wanted)))
    last = F.floor((F.size("whole") - 1) / CHUNK_WORDS).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda n: chunk(n, F.col("whole")))
    cut = with_any.select("id", "text_hash", F.inline(chunks))

    def hit(w: Column, i: Column) -> Column:
        return F.when(w.isin(wanted), F.struct((i + F.col("chunk") * CHUNK_WORDS).alias("place"), w.alias("word")))

    hits = F.filter(F.transform("words", hit), lambda h: h.isNotNull())
    return cut.withColumn("hits", hits).filter(F.size("hits") > 0)


def _matches(anchored: DataFrame, part: Part) -> DataFrame:
    """(id, text_hash, license, start, first, containment): windows that contain enough of a template, and its first word there."""
    placed = F.flatten(
        F.transform(
            part.windows(),
            lambda size: F.transform(
                _starts(F.col("chunk"), F.col("hits"), size),
                lambda at: F.struct(at.alias("start"), *[size[f].alias(f) for f in ("class", "length", "bands")]),
            ),
        )
    )
    windows = anchored.select("id", "text_hash", "chunk", "words", F.inline(placed))
    own = F.slice("words", F.col("start") - F.col("chunk") * CHUNK_WORDS + 1, F.col("length"))
    windows = windows.select("id", "text_hash", "class", "start", "bands", own.alias("own"))
    windows = windows.withColumn("shingles", _shingles(F.col("own"))).drop("own")
    hashed = windows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    keys = F.posexplode(_bands(F.col("hashes"), F.col("bands"))).alias("band", "key")

    known = part.known(anchored.sparkSession)
    known_hashes = known.withColumn("hashes", F.transform("asked", lambda s: F.xxhash64(s)))
    # Shingles are broadcast once a template, not once a band.
    met = hashed.select("id", "text_hash", "start", "shingles", "class", keys).join(
        F.broadcast(known_hashes.select("license", "class", keys)), ["class", "band", "key"]
    )
    compared = met.join(F.broadcast(known.select("license", "asked")), "license")
    containment = F.size(F.array_intersect("shingles", "asked")) / F.size("asked")
    matching = compared.withColumn("containment", containment).filter(F.col("containment") >= CONTAINMENT)
    first = F.array_position(F.transform("shingles", lambda s: F.array_contains("asked", s)), F.lit(True)).cast("int") - 1
    return matching.select("id", "text_hash", "license", "start", (F.col("start") + first).alias("first"), "containment")


def find_licenses(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_words: int = PART_WORDS,
) -> DataFrame:
    """One row per document and template that it holds: the id, text_hash, license, containment, first_word,
    windows. ``first_word`` is where the template's first shingle in the best windows stands, the first one of equally good
    windows; ``windows`` is how many match.

    Words are compared in lower case, without punctuation. Documents without a match, null and empty texts
    give no row; rows that repeat in id and text count once; a null id is kept. Other columns are not read.
    Template sets beyond ``part_words`` words are scanned for in several parts, from the same staged chunks.
    """
    templates = NOTICES if templates is None else templates
    worded = {name: own for name, text in templates.items() if (own := template_words(text))}
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not worded:
        ddl = f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, license string, start int, first int, containment double"
        found = documents.sparkSession.createDataFrame([], ddl)
    else:
        wanted = sorted(set().union(*map(anchors, worded.values())))
        overlap = max(WindowClass.of(len(own)).length for own in worded.values())
        anchored = stage(_anchored(rows, wanted, overlap), "license_candidates")
        found = reduce(DataFrame.unionByName, [_matches(anchored, part) for part in parts_of(worded, part_words)])
    best = F.max(F.struct("containment", (-F.col("first")).alias("back")))
    summed = found.groupBy("id", "text_hash", "license").agg(best.alias("best"), F.count_distinct("start").alias("windows"))
    return summed.select(
        F.col("id").alias(id_col),
        "text_hash",
        "license",
        F.col("best.containment").alias("containment"),
        (-F.col("best.back")).alias("first_word"),
        "windows",
    )
