"""Allow and block rules for URLs: a trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and all subdomains, where the URL's path starts with the
rule's. Of the rules that fit, the longest wins: the longest host, then the longest path; between equal
rules a block wins. URLs that no rule fits get the default verdict.

The trie is broadcast while the rules are within a size limit. Beyond it, the distinct pairs of host and
path are joined with the rules by host suffix and first path segment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Characters of rules up to which the trie is broadcast.
MOST_BROADCAST_CHARS = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a URL; both empty for a null URL or one without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class _Node:
    """Rules below a host, or below a host and some path segments.

    ``ends`` has verdicts of rules by the beginning of the next segment that they ask for.
    """

    __slots__ = ("ends", "labels", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}


class UrlTrie:
    """Longest-match lookup."""

    def __init__(self, rules: list[Rule]) -> None:
        self._root = _Node()
        for host, path, verdict in rules:
            node = self._root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if begun not in node.ends or verdict == BLOCK:
                node.ends[begun] = (host + path, verdict)

    @staticmethod
    def _by_path(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.ends:
                for n in range(len(segment), -1, -1):
                    if segment[:n] in node.ends:
                        best = node.ends[segment[:n]]
                        break
            node = node.segments.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        node, best, segments = self._root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._by_path(node, segments) or best
        return best


def _by_trie(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    trie = UrlTrie(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return parts.withColumn("_judged", judge("_host", "_path"))


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    urls = parts.select(F.col("_host").alias("h"), F.col("_path").alias("p")).distinct()
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    first = F.when(F.size(F.split("p", "/")) > 2, F.split("p", "/")[1])
    either = F.array_distinct(F.array(F.lit(None).cast("string"), first))
    keyed = urls.select("h", "p", F.explode(suffixes).alias("on")).select("h", "p", "on", F.explode(either).alias("seg"))
    rule_first = F.when(F.size(F.split("path", "/")) > 2, F.split("path", "/")[1])
    asked = rules.select("host", "path", "verdict", rule_first.alias("rule_seg"))
    fits = (F.col("on") == F.col("host")) & F.col("seg").eqNullSafe(F.col("rule_seg")) & F.col("p").startswith(F.col("path"))
    rank = F.struct(F.length("host"), F.length("path"), F.col("verdict") == BLOCK, F.concat("host", "path").alias("rule"), "verdict")
    best = keyed.join(asked, fits).groupBy("h", "p").agg(F.max(rank).alias("best"))
    known = best.select("h", "p", F.struct("best.rule", "best.verdict").alias("_judged"))
    return parts.join(known, (F.col("_host") == F.col("h")) & (F.col("_path") == F.col("p")), "left").drop("h", "p")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url_col: str = "url",
    default: str = ALLOW,
    most_broadcast_chars: int = MOST_BROADCAST_CHARS,
) -> DataFrame:
    """The pages with one more column ``url_filter``: host, path, rule (host and path, or null), verdict.

    ``rules`` (host, path, verdict) may be empty; those with a null host or a verdict other than allow and
    block are left out, a null path fits every path, repeated rules count once. A URL that is null or has
    no ``://`` has an empty host and path. Repeated pages and other columns are kept as they are; an
    earlier ``url_filter`` column is replaced.
    """
    asked = rules.select(
        F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict")
    )
    asked = asked.filter(F.col("host").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)).distinct()
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.struct("*").alias("_row"), host.alias("_host"), path.alias("_path"))
    chars = asked.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    if chars <= most_broadcast_chars:
        judged = _by_trie(parts, [tuple(r) for r in asked.collect()])
    else:
        judged = _by_join(parts, asked)
    verdict = F.struct(
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_judged.rule").alias("rule"),
        F.coalesce("_judged.verdict", F.lit(default)).alias("verdict"),
    )
    kept = [F.col(f"_row.`{c}`") for c in pages.columns if c != "url_filter"]
    return judged.select(*kept, verdict.alias("url_filter"))
