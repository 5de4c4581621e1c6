"""SimHash near-duplicates, linked by a self-join of the binary trie of all fingerprints.

A trie node is a bit prefix. The join starts from pairs of nodes at one depth that differ in no more
bits than the budget, walks both subtrees of a pair together bit by bit, adds up the differing bits,
and drops a pair as soon as they exceed the budget. Every pair of top nodes is one group of work:
a fingerprint goes to the groups of its own node and of the nodes within the budget.

Equal fingerprints are one leaf, so copies cost nothing. The depth follows from the number of
fingerprints and from the fullest node, so that a cluster of near copies is cut too. A group returns a
forest of its links, not the links themselves; components of the forests give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.components import connected_components
from tillwise.sources.shared import stage, staged

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
BITS = 64
#: Fingerprints a top node should hold on average, and at most where the deepest level allows.
NODE_MEAN, NODE_MOST, DEEPEST = 2048, 16_384, 16
#: Node pairs that are walked at once.
FRONTIER = 1 << 20

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: bit i is set when it is set in over half of the shingles' hashes."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    shingles = zip(*(parts[k:] for k in range(words)), strict=False) if len(parts) >= words else [parts]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in shingles], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        set_bits = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        counts = [np.bincount(octets[:, k], minlength=256) for k in range(8)]
        set_bits = np.concatenate([c @ _BIT_OF_BYTE for c in counts])
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprints as signed 64-bit numbers. A text without words has fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text.cast("string"))


def _forest(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The forest of least roots after the links are added."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (parent != (up := parent[parent])).any():
            parent = up


def trie_links(
    values: np.ndarray, start: tuple[int, int, int, int], spent: int, bit: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted values that differ in at most ``budget`` bits.

    ``start`` has the ranges of two trie nodes, the same one twice for a self-join, which differ in
    ``spent`` bits above ``bit``.
    """
    walks = [(bit, *(np.array([x]) for x in start), np.array([spent]))]
    while walks:
        bit, lo1, hi1, lo2, hi2, spent = walks.pop()
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            walks.append((bit, lo1[half:], hi1[half:], lo2[half:], hi2[half:], spent[half:]))
            lo1, hi1, lo2, hi2, spent = lo1[:half], hi1[:half], lo2[:half], hi2[:half], spent[:half]
            walks.append((bit, lo1, hi1, lo2, hi2, spent))
            continue
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            i, j = lo1[single], lo2[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            yield i[near], j[near]
            lo1, hi1, lo2, hi2, spent = lo1[~single], hi1[~single], lo2[~single], hi2[~single], spent[~single]
        if not len(lo1):
            continue
        one = np.uint64(1 << bit)
        above = ~np.uint64((2 << bit) - 1 & (1 << BITS) - 1)
        mid1 = np.clip(np.searchsorted(values, values[lo1] & above | one), lo1, hi1)
        mid2 = np.clip(np.searchsorted(values, values[lo2] & above | one), lo2, hi2)
        twin = lo1 == lo2
        parts = [
            (lo1, mid1, lo2, mid2, spent),
            (mid1, hi1, mid2, hi2, spent),
            (lo1, mid1, mid2, hi2, spent + 1),
            (mid1[~twin], hi1[~twin], lo2[~twin], mid2[~twin], spent[~twin] + 1),
        ]
        nodes = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alive = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget)
        walks.append((bit - 1, *(x[alive] for x in nodes)))


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(budget + 1) for chosen in combinations(range(bits), n)]


def _depth(distinct: DataFrame, budget: int) -> int:
    """The level of the top nodes; from the counts of at most 2^DEEPEST prefixes."""
    top = F.shiftrightunsigned("fp", BITS - DEEPEST)
    counts = np.zeros(1 << DEEPEST, np.int64)
    for prefix, n in distinct.groupBy(top.alias("prefix")).count().collect():
        counts[prefix] = n
    depth = max(0, math.ceil(math.log2(max(1, counts.sum()) / NODE_MEAN)))
    while depth < DEEPEST and counts.reshape(1 << depth, -1).sum(axis=1).max() > NODE_MOST:
        depth += 1
    return min(depth, DEEPEST)


def near_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, links) for linked fingerprints of ``distinct`` (fp): per group of work, the least one of
    its forest there, and how many links it has there. Links of a fingerprint add up over the groups."""
    depth = _depth(distinct, max_distance)
    node = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    other = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(depth, max_distance)]))
    grouped = (
        distinct.select("fp", node.alias("node"), other.alias("mask"))
        .select("fp", "node", F.col("node").bitwiseXOR(F.col("mask")).alias("beside"))
        .select("fp", F.least("node", "beside").alias("p"), F.greatest("node", "beside").alias("q"))
    )

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = (int(k) for k in key)
        values = np.sort(rows["fp"].to_numpy().view(np.uint64))
        n = len(values)
        parent, degree = np.arange(n), np.zeros(n, np.int64)
        cut = int(np.searchsorted(values, np.uint64(q << (BITS - depth)))) if depth else 0
        start = (0, n, 0, n) if p == q else (0, cut, cut, n)
        if n and (p == q or 0 < cut < n):
            for left, right in trie_links(values, start, (p ^ q).bit_count(), BITS - 1 - depth, max_distance):
                if len(left):
                    degree += np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
                    parent = _forest(n, left, right, parent)
        linked = degree > 0
        return pd.DataFrame(
            {"fp": values[linked].view(np.int64), "root": values[parent[linked]].view(np.int64), "links": degree[linked]}
        )

    return grouped.groupBy("p", "q").applyInPandas(links, "fp long, root long, links long")


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per document: the id, fp, class_fp, component_id, n_links.

    Fingerprints link when they differ in at most ``max_distance`` bits, and documents with linked or
    equal fingerprints share a component; ``class_fp`` names it, ``component_id`` is its smallest id
    (null when it has none) and ``n_links`` counts the other fingerprints that a document's links to.
    Null and empty texts have fingerprint 0. Repeated rows and rows without an id are kept. Other columns
    are not read. An empty table gives no row.
    """
    marked = stage(documents.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), words).alias("fp")), "simhash")
    with ExitStack() as held:
        leaves = held.enter_context(staged(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash_leaves"))
        links = held.enter_context(staged(near_links(leaves.select("fp"), max_distance), "simhash_links"))
        classes = connected_components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
        degrees = links.groupBy("fp").agg(F.sum("links").alias("n_links"))
        rooted = (
            leaves.join(classes.withColumnRenamed("node", "fp"), "fp", "left")
            .join(degrees, "fp", "left")
            .select("fp", "low", F.coalesce("root", "fp").alias("class_fp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
        lows = rooted.groupBy("class_fp").agg(F.min("low").alias("component_id"))
        known = stage(rooted.drop("low").join(lows, "class_fp"), "simhash_classes")
    return marked.join(known, "fp").select(F.col("id").alias(id_col), "fp", "class_fp", "component_id", "n_links")


def near_duplicates_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints as 16 lowercase hex digits."""
    hexes = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(id_col, hexes.alias("fingerprint"), "component_id", "n_links")


def drop_near_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with its smallest id; columns unchanged.

    A component without ids keeps one of its documents, as does one whose smallest id is repeated.
    """
    found = stage(near_duplicates(documents, id_col=id_col, text_col=text_col), "simhash_found")
    ids = F.col(id_col)
    kept = (
        found.filter(ids.eqNullSafe(F.col("component_id")))
        .groupBy("class_fp", ids.alias("_keep_id"))
        .agg(F.min("fp").alias("_keep_fp"))
    )
    repeated = found.groupBy(ids.alias("_twice")).count().filter("count > 1 or _twice is null").select("_twice")
    marked = documents.select(F.struct("*").alias("_row"), ids.alias("_id"))

    def matching(some: DataFrame) -> DataFrame:
        return marked.join(some, F.col("_id").eqNullSafe(F.col("_keep_id")))

    is_twice = F.col("_keep_id").eqNullSafe(F.col("_twice"))
    out = matching(kept.join(repeated, is_twice, "left_anti")).select("_row.*")
    unsure = kept.join(repeated, is_twice, "left_semi")
    if unsure.isEmpty():
        return out
    told_apart = matching(unsure).withColumn("_fp", fingerprints(F.col(f"_row.`{text_col}`"))).filter("_fp = _keep_fp")
    return out.unionByName(told_apart.dropDuplicates(["class_fp"]).select("_row.*"))
