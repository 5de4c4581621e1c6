"""Secrets in documents, found with a trigram inverted index and verified by their regexes.

From each rule's regex a Boolean query over trigrams follows: every match contains the trigrams that the
query asks for. Postings list, per trigram and shard, the texts that contain it; the queries intersect
and unite them, and only the texts they return are searched by the rule. A rule without mandatory
trigrams searches every text. Texts are identified by a hash, so copies are one posting, and two texts
with one hash only mean that one more text is verified.

Everything is done by DataFrame functions. Positions come from splitting a text at a rule's matches: the
pieces and the matches alternate, and their lengths are summed up. The postings hold only the trigrams that the rules ask
for, so they are made anew for each set of rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrays import with_running_sum
from tillwise.sources.shared import stage, staged

#: Texts per shard of the index, on average; bounds the lists that are intersected.
SHARD_TEXTS = 4096
#: Strings that a part of a regex may stand for and still be followed literally.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


# Runs of one class are as long as they can be, so that asking for 24 hex digits, or for 16 characters
# after AKIA, leaves the same matches as dropping shorter ones afterwards.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]

#: A trigram, or ("and" | "or", parts). An "and" without parts asks for nothing.
Query = str | tuple[str, tuple]
ANY: Query = ("and", ())


def _both(a: Query, b: Query) -> Query:
    parts = [p for q in (a, b) for p in (q[1] if q[0] == "and" and not isinstance(q, str) else (q,))]
    return ("and", tuple(dict.fromkeys(parts)))


def _of_strings(strings: frozenset[str]) -> Query:
    """One of the strings is contained, as far as trigrams can tell."""
    asked = [("and", tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))) for s in sorted(strings)]
    if any(a == ANY for a in asked):
        return ANY
    return asked[0] if len(asked) == 1 else ("or", tuple(asked))


def _follow(items: list) -> tuple[frozenset[str] | None, Query]:
    """The strings that a part of a regex stands for, if they are few, and what it asks for besides."""
    strings: frozenset[str] = frozenset([""])
    asked, exact = ANY, True
    for kind, of in items:
        own, more = _strings_of(kind, of)
        asked = _both(asked, more)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, own))
            continue
        asked, exact = _both(asked, _of_strings(strings)), False
        strings = own if own is not None else frozenset([""])
    return (strings, asked) if exact else (None, _both(asked, _of_strings(strings)))


def _strings_of(kind: object, of: object) -> tuple[frozenset[str] | None, Query]:
    if kind is op.LITERAL:
        return frozenset([chr(of).lower()]), ANY
    if kind is op.IN and all(k is op.LITERAL for k, _ in of):
        return frozenset(chr(c).lower() for _, c in of), ANY
    if kind is op.SUBPATTERN:
        return _follow(list(of[-1]))
    if kind is op.BRANCH:
        found = [_follow(list(branch)) for branch in of[1]]
        if all(s is not None and q == ANY for s, q in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return frozenset().union(*(s for s, _ in found)), ANY
        asked = [q if s is None else _both(q, _of_strings(s)) for s, q in found]
        return None, ANY if ANY in asked else ("or", tuple(asked))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = of
        strings, asked = _follow(list(inner))
        if (least, most) == (0, 1) and strings is not None and asked == ANY:
            return strings | {""}, ANY
        if least == 0:
            return None, ANY
        return None, asked if strings is None else _both(asked, _of_strings(strings))
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """What a lower-cased text with a match must contain."""
    strings, asked = _follow(list(regex_tree.parse(pattern)))
    return asked if strings is None else _both(asked, _of_strings(strings))


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _postings(texts: DataFrame, asked: list[str], shards: int) -> DataFrame:
    """(shard, trigram, list): which texts (hash, text) of a shard contain a trigram."""
    folded = texts.select("hash", F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.col("folded").contains(t), F.lit(t)) for t in asked]))
    pairs = folded.select("hash", F.explode(present).alias("trigram"))
    shard = F.pmod("hash", F.lit(shards)).alias("shard")
    return pairs.groupBy(shard, "trigram").agg(F.collect_set("hash").alias("list"))


def _evaluate(query: Query, lists: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return lists[query]
    combine = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(combine, [_evaluate(part, lists) for part in query[1]])


def candidates(texts: DataFrame, rules: list[Rule], shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(hash, kinds): texts (hash, text) that the trigram queries of rules return, and for which kinds; staged."""
    indexed = [r for r in rules if r.query != ANY]
    asked = sorted(set().union(*(trigrams(r.query) for r in indexed)))
    shards = max(1, texts.count() // shard_texts)
    none = F.array().cast("array<bigint>")
    lists = {t: F.coalesce(F.col(f"list_{i}"), none) for i, t in enumerate(asked)}
    with staged(_postings(texts, asked, shards), "trigram_postings") as postings:
        by_shard = postings.groupBy("shard").agg(
            *[F.first(F.when(F.col("trigram") == t, F.col("list")), ignorenulls=True).alias(f"list_{i}") for i, t in enumerate(asked)]
        )
        returned = [F.struct(F.lit(r.kind).alias("kind"), _evaluate(r.query, lists).alias("hashes")) for r in indexed]
        named = F.array(*returned)
        found = by_shard.select(F.inline(named)).select("kind", F.explode("hashes").alias("hash"))
        return stage(found.groupBy("hash").agg(F.collect_set("kind").alias("kinds")), "secret_candidates")


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches as structs (start, number, end, kind), in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match"), measured.alias("part")), lambda x: x["match"].isNotNull())

    def measure(x: Column) -> Column:
        size = F.length(x["match"])
        return F.struct((F.length(x["gap"]) + size).alias("end"), size.alias("size"), F.length(x["part"]).alias("part"))

    placed = with_running_sum(F.transform(parts, measure), "end", ["end", "size", "part"])
    return F.transform(
        F.filter(placed, lambda x: x["part"] >= rule.least),
        lambda x: F.struct(
            (x["end"] - x["size"]).alias("start"), F.lit(number).alias("number"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")
        ),
    )


def find_secrets(
    documents: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: the id and ``spans``, an array of (start, number, end, kind), sorted.

    ``number`` is the rule's place in ``rules``. Null and empty texts have no spans; repeated rows and null
    ids are kept; other columns are not read. An empty table gives no row.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias(id_col), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    everywhere = {r.kind for r in rules if r.query == ANY}
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    if len(everywhere) < len(rules):
        chosen = candidates(rows.select("hash", "text"), rules)
        rows = rows.join(chosen.withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    found = []
    for number, rule in enumerate(rules):
        if rule.kind in everywhere:
            wanted = F.col("text").rlike(rule.pattern)
        else:
            wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        found.append(F.when(wanted, _spans(F.col("text"), rule, number)).otherwise(none))
    return rows.select(id_col, F.array_sort(F.concat(*found)).alias("spans"))


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, a checksum of the base spans, and all spans as kind:start:end."""
    base = len(BASE_RULES)

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("long")

    counts = [count(number).alias(f"n_{rule.kind}") for number, rule in enumerate(BASE_RULES)]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        id_col,
        *counts,
        F.sha2(shown(F.filter("spans", lambda s: s["number"] < base)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def plain_matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Spans of a rule in one text, by its regex alone."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
