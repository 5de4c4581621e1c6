"""Prefix trie, WARC archives and phrase collocations against plain versions, on odd rows and small bounds."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from llm_cases import ODD, frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillwise.llm import collocations, prefix_trie, queries, warc
from tillwise.sources import Tables, shared_folder

# ---- prefix trie ----

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def trie(conversations, opened=True):
    """Per (smallest member, depth): parent, members, children, leaves, saved, hash of the ends."""
    turns = defaultdict(list)
    for conv, turn, role, text in conversations:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(of)] for c, of in turns.items()}
    if opened:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        turns = {c: turns.get(c - c % 100, [])[: h[c]] + of[h[c] :] for c, of in turns.items()}
    members = defaultdict(list)
    for c, of in turns.items():
        for d in range(len(of) + 1):
            members[tuple(of[:d])].append(c)

    @cache
    def totals(node):
        below = [totals(n) for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return len(below), sum(b[1] for b in below) or 1, saved + sum(b[2] for b in below)

    out = {}
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(turns[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(of), len(node)] = (parent, len(of), *totals(node), hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(spark, rows, tmp_path, opened=True):
    turns = spark.createDataFrame(rows, TURN_SCHEMA).selectExpr("*", *[f"'x' as `{c}`" for c in ("id", "pos", "symbol", "chars", "depth", "name", "part", "row", "block")])
    if opened:
        turns.write.parquet(f"{tmp_path}/conversations.parquet")
        got = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    else:
        ordered = prefix_trie.ordered_turns(turns)
        got = prefix_trie.prefix_trie(ordered.select("id").distinct(), ordered).collect()
    assert len({(r[0], r[1]) for r in got}) == len(got)
    return {(r[0], r[1]): tuple(r)[2:] for r in got}


def test_trie_of_odd_conversations(spark, tmp_path):
    rows = [
        (100, 0, "user", "hi"), (100, 1, "assistant", "hello"), (100, 2, None, None), (100, None, "system", "be kind"),
        (101, 0, "user", "hi"), (101, 0, "user", "hi"), (101, 5, "user", ""), (101, 4, "user", "é\U0001f600"),
        (102, 7, "user", "hi"), (None, 1, "user", "lost"), (250, None, None, None), (251, 1, "user", "x" * 200_000), (301, 1, "user", "no giver"),
        (7, 1, "user", "hi"), (0, 1, "user", "hi"), (10**12, 3, "user", "hi"), (10**12 + 1, 3, "user", "hi"),
    ]
    assert found_trie(spark, rows, tmp_path) == trie(rows)


@pytest.mark.parametrize("opened", [True, False])
def test_trie_of_many_conversations(spark, tmp_path, opened):
    """A third of the turns in one conversation, a third of the conversations equal, few words."""
    dice = random.Random(5)
    rows = [(c, t, dice.choice("ua"), dice.choice(["", "a", "bb"])) for c in range(0, 400, 3) for t in range(dice.randrange(1, 9))]
    rows += [(1000 + c, t, "u", f"copy {t}") for c in range(70) for t in range(6)]
    rows += [(900, t, "u", dice.choice("ab")) for t in range(600)] + [(901, t, "u", "b") for t in range(37)]
    assert found_trie(spark, rows, tmp_path, opened) == trie(rows, opened)


def test_trie_without_turns(spark, tmp_path):
    assert found_trie(spark, [(None, 0, "user", "x")], tmp_path) == {}
    # Conversation 301 has no giver and fewer turns than it gives up.
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    (tmp_path / "alone").mkdir()
    got = found_trie(spark, [(alone, 0, "user", "gone")], tmp_path / "alone")
    assert got == {(alone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}


def test_trie_with_text_ids_and_what_it_leaves(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 3)
    rows = [(f"c{i:03d}", 0, "u", "same") for i in range(50)] + [("a", 0, "u", "same"), ("a", 1, "u", "more")]
    folder = Path(shared_folder(spark))
    outside = set(folder.iterdir()) if folder.exists() else set()
    with Tables(spark):
        ordered = prefix_trie.ordered_turns(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
        before = set(folder.iterdir())
        got = prefix_trie.prefix_trie(ordered.select("id").distinct(), ordered)
        assert len(set(folder.iterdir()) - before) == 1
        by_depth = {r.depth: r for r in got.collect()}
    assert set(folder.iterdir()) == outside
    ends = hashlib.sha256(",".join(f"c{i:03d}" for i in range(50)).encode()).hexdigest()
    assert tuple(by_depth[0]) == ("a", 0, None, 51, 1, 1, 200, EMPTY_HASH)
    assert tuple(by_depth[1]) == ("a", 1, "a", 51, 1, 1, 200, ends) and by_depth[2].ends_sha256 == hashlib.sha256(b"a").hexdigest()


# ---- WARC ----

PAYLOADS = [
    "", None, "a\r\n", "a\r\n\r\n", "a\r\n\r\n\r\n", "x\r", "x\r\n\r", "\r\n", "\r\n\r\n", "same", "same", "é\U0001f600" * 50_000,
    "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\n" * 70_000 + "\r\n\r\n" * 20_000 + "\r\n", "same", "a\r\n",
]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def page_rows():
    rows = [(100 - i, f"http://x.example/ä b\r\nWARC-Type: x?{i}" if i % 2 else None, p) for i, p in enumerate(PAYLOADS)]
    return rows + [(None, "http://a.b", "same"), (100, "u", ""), (100, "u", ""), (None, None, "z"), (None, "http://q", "z")]


def test_pages_come_back_from_archives(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").selectExpr("*", *[f"'x' as `{c}`" for c in ("row", "key", "id", "payload", "urn", "value", "type")])
    for least in (0, 5):
        path = f"{tmp_path}/warc{least}"
        warc.write_archives(warc.archive_records(pages, least_bytes=least), path)
        records = warc.read_records(spark, path)
        kinds = Counter(r.type for r in records.collect())
        assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(page_rows())
        found = warc.captures(records)
        assert all(len(r.requests) == len(r.metadata) == 1 and r.capture is not None for r in found.collect())
        got = Counter((int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.kind, int(r.refers_to) if r.refers_to else None) for r in warc.resolved(found).collect())
        groups = defaultdict(list)
        for page_id, _, html in page_rows():
            groups[html or ""].append(page_id)
        wanted = Counter()
        for html, ids in groups.items():
            ids.sort(key=lambda i: (i is None, -(i or 0)))
            size = len(html.encode())
            for place, page_id in enumerate(ids):
                first = place == 0 or size < least
                wanted[page_id, size, digest(html), "response" if first else "revisit", None if first else ids[0]] += 1
        assert got == wanted
        whole = {bytes(r.payload).decode() for r in records.filter("type = 'response'").collect()}
        assert whole == set(groups)


def test_archives_of_no_page(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op12_warc(spark, str(tmp_path)).count() == 0


def _warc(kind, record_id, block, *fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A gzip member per record, links in either direction, folded headers, bytes that are no text, records that belong nowhere."""
    body = bytes(range(256)) * 300
    http = "Content-Type: application/http; msgtype=response"
    records = [
        _warc("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        _warc("request", "q", b"GET / HTTP/1.0\r\n\r\n"),
        _warc("response", "r", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n" + body, http, "WARC-Concurrent-To: <q>", "WARC-Target-URI: http://x/\r\n y"),
        _warc("metadata", "m", b"page_id: 5\r\nvia: a\r\n b\r\n", "WARC-Concurrent-To: <r>", "Content-Type: application/warc-fields"),
        _warc("metadata", "lost", b"page_id: 6\r\n", "WARC-Concurrent-To: <nowhere>", "Content-Type: application/warc-fields"),
        _warc("request", "alone", b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_warc("revisit", "v", b"HTTP/1.0 200 OK\r\n\r\n", "WARC-Refers-To: <r>")))
    (tmp_path / "notes.txt").write_text("no archive")
    read = warc.read_records(spark, str(tmp_path))
    assert read.count() == 7
    found = {r.capture_id: r for r in warc.captures(read).collect()}
    assert set(found) == {"<r>", "<v>", "<nowhere>", "<alone>"}
    one = found["<r>"]
    assert bytes(one.capture.payload) == body and one.capture.target_uri == "http://x/ y"
    assert [m.record_id for m in one.requests] == ["<q>"] and one.metadata[0].fields == [("page_id", "5"), ("via", "a b")]
    assert found["<nowhere>"].capture is None and found["<nowhere>"].metadata[0].record_id == "<lost>" and found["<v>"].metadata == []
    flat = {r.capture_id: tuple(r)[1:] for r in warc.resolved(warc.captures(read)).collect()}
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert flat == {"<r>": ("5", "response", None, len(body), sha), "<v>": (None, "revisit", "5", len(body), sha)}


@pytest.mark.parametrize("broken", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"no record\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"])
def test_broken_archives_fail(spark, tmp_path, broken):
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(broken))
    with pytest.raises(PySparkException, match="bad.warc.gz"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_records_are_cut_by_their_length_wherever_pieces_end():
    dice = random.Random(3)
    for _ in range(300):
        blocks = [bytes(dice.choices(b"\r\na", k=dice.randrange(12))) for _ in range(3)]
        data = b"".join(_warc("resource", i, b) for i, b in enumerate(blocks))
        stream = warc.RecordStream("x")
        got = [block for piece in data.split(b"\r\n\r\n") for _, block in stream.add(piece)]
        stream.close()
        assert got == blocks


# ---- collocations ----


def plain_words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def plain_counts(rows, threshold):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in plain_words(text):
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {lang: {p: f for p, f in of.items() if f >= threshold} for lang, of in counts.items()}, totals


def plain_collocations(rows, threshold, top):
    out = []
    counts, totals = plain_counts(rows, threshold)
    for lang, of in counts.items():
        longer = defaultdict(int)
        for p, f in of.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f)
        found = []
        for p, a in of.items():
            if len(p) > 1 and 100 * longer[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def documents(dice, n):
    common = ["red sea", "red sea port", "Big Apple pie: crust", "x", "é É ï", "a\tb"]
    parts = [*common, *[f"w{i}" for i in range(30)], ".", ", ", "!\r\n", "\x0b", "\xa0"]
    texts = [" ".join(dice.choices(parts, k=dice.randrange(60))) for _ in range(n)]
    return [(dice.choice(["en", "en", "de", None, ""]), t) for t in texts]


@pytest.mark.parametrize("bounds", [{}, {"SLAB_BYTES": 7, "WORDS_AT_ONCE": 50, "MOST_KNOWN_WORDS": 5, "CAPACITY_FACTOR": 0, "MOST_BITS": 1 << 10, "RANK_PARTS": 3}])
def test_collocations_equal_a_plain_version(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(collocations, name, value)
    dice = random.Random(8)
    rows = documents(dice, 300)
    rows += [("en", "hot phrase of the day. " * 400), ("en", "one " * 3000), (None, None), ("de", ""), ("de", "no" * 100_000), (None, " ".join(["big", "apple"] * 40))]
    rows = rows + rows[:3]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(5)
    docs = docs.selectExpr("*", *[f"'x' as `{c}`" for c in ("words", "phrase", "f", "part", "keys", "n", "k", "l", "r", "score", "rank")])
    for threshold in (5, 30):
        counts = collocations.phrase_counts(docs, threshold=threshold)
        wanted, totals = plain_counts(rows, threshold)
        assert {(r.lang, r.phrase): (r.words, r.f) for r in counts.collect() if r.phrase is not None} == {
            (lang, " ".join(p)): (len(p), f) for lang, of in wanted.items() for p, f in of.items()
        }
        assert {r.lang: r.f for r in counts.collect() if r.phrase is None and r.f} == {k: v for k, v in totals.items() if v}
        top = collocations.top_collocations(collocations.collocations(counts), counts, 20)
        assert sorted(tuple(r) for r in top.collect()) == plain_collocations(rows, threshold, 20)


def test_collocations_of_odd_rows_and_empty_tables(spark):
    docs = frame(spark)
    assert collocations.phrase_counts(docs.limit(0)).count() == 0
    counts = collocations.phrase_counts(docs)
    rows = [(r[2], r[1]) for r in ODD]
    assert sorted(tuple(r) for r in collocations.top_collocations(collocations.collocations(counts), counts).collect()) == plain_collocations(rows, 30, 2000)
    big = spark.createDataFrame([("x", 1, "a", 10**18), ("x", 1, "b", 3 * 10**18), ("x", 2, "a b", 10**18)], "lang string, words int, phrase string, f long")
    assert [tuple(r) for r in collocations.collocations(big).collect()] == [("x", "a b", 10**18, 10**18, 3 * 10**18, 500_000)]


def test_summaries_keep_every_frequent_key():
    """Whatever the capacity, the order and the merging, and with subtractions."""
    dice = np.random.default_rng(4)
    for capacity in (1, 50, 400, 5000):
        stream = np.concatenate([np.repeat(np.arange(40, dtype=np.uint64), 30), np.arange(1000, 9000, dtype=np.uint64), np.full(5000, 77, np.uint64)])
        dice.shuffle(stream)
        summary = collocations.MisraGries(capacity, 30)
        for part in np.array_split(stream, 37):
            summary.add(*collocations._summed(part, np.ones(len(part), np.int64)))
        kept = summary.survivors()
        assert set(range(40)) | {77} <= set(kept.tolist()) and summary.error < 30
        if capacity == 400:  # above the mass by the threshold, so that it never grows
            assert 0 < summary.error and summary.capacity <= 800 and len(kept) < 8000


def test_phrases_that_only_a_summary_keeps_are_counted_out(spark, monkeypatch):
    """With hashes of few bits everything collides; the second pass still gives exact counts."""
    monkeypatch.setattr(collocations, "SPARE_BITS", -20)
    rows = documents(random.Random(2), 200)
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    counts = collocations.phrase_counts(docs, threshold=12)
    wanted, _ = plain_counts(rows, 12)
    assert counts.filter("phrase is not null").count() == sum(map(len, wanted.values()))
    assert counts.filter(F.col("phrase").isNotNull() & (F.col("f") < 12)).count() == 0
