"""Hand-made documents and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import xxhash

LONG = "lorem ipsum dolor sit amet " * 8000

#: (doc_id, text, lang, source, n_chars), with nulls, empty, repeated and long rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, "a", 3),
    (4, "Same text here", "en", None, 14),
    (5, "Same  text\there", "en", "b", 15),
    (6, "Same text here", "en", "b", 14),
    (6, "Same text here", "en", "b", 14),
    (None, "Same text here", "en", "b", 14),
    (None, "only without an id", "en", "b", 18),
    (7, LONG, "en", "c", len(LONG)),
    (8, "é ü ñ 你好 \U0001f600 <|endoftext|> x", "fr", "c", 10),
    (9, "12 34 -- !!", "de", "c", 11),
    (9, "other text, same id", "de", "c", 11),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for columns of their own.
CLASHING = (
    "id hash norm head side kept fp low root links class_fp component_id segment ordinal items n_words score y terms place "
    "_row _id _keep_id _sha spans kinds start lang_pred rule verdict host path url_filter tokens ids piece count node a b"
).split()


def frame(spark, rows=ODD, clash=True):
    """The rows as documents, with more columns whose names clash with those of the operators."""
    made = spark.createDataFrame(list(rows), SCHEMA)
    return made.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING]) if clash else made


def same_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def exact_groups(rows):
    """Per normalised text: (chars, id) of the row that stays and the number of rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[same_text(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {norm: (min(of)[3], len(of), hashlib.sha256(norm.encode()).hexdigest()) for norm, of in groups.items()}


def simhash(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), seed=42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def linked_classes(values, budget=2):
    """For each value a name of its class, and how many others it links to."""
    distinct = sorted(set(values))
    parent, links = {v: v for v in distinct}, dict.fromkeys(distinct, 0)

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= budget:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {v: find(v) for v in distinct}, links


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, window=13):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of one text."""
    words, hit, found = bench_words(text), set(), set()
    for item_id, item_text in items:
        own = bench_words(item_text)
        size = min(window, len(own))
        shown = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in shown:
                hit.update(range(i, i + size))
                found |= {str(item_id)} if item_id is not None else set()
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)
