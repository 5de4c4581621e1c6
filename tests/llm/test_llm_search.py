from __future__ import annotations

import random
import re
import time
from collections import Counter
from dataclasses import replace

import pytest
from llm_cases import ODD, contamination, frame

from pyspark.sql import functions as F

from tillwise.llm import decontamination, licenses, secrets, url_filter
from tillwise.llm.arrays import with_running_sum

VOCABULARY = [f"w{i}" for i in range(40)] + ["the", "of", "and"]


def _passage(random_, n):
    return " ".join(random_.choice(VOCABULARY) for _ in range(n))


ITEMS_DDL = "item_id long, text string, n_words long, id string"


def test_contamination_equals_the_definition(spark):
    r = random.Random(5)
    items = [(i, _passage(r, r.choice([3, 12, 13, 14, 40]))) for i in range(30)]
    items += [(30, items[4][1]), (30, items[4][1]), (None, _passage(r, 20)), (31, None), (32, ""), (33, "!!"), (34, "Éa Éb 12")]
    rows = [(i, t) for i, t, *_ in ODD]
    for i in range(60):
        text = _passage(r, r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            text += ". " + (items[r.randrange(len(items))][1] or "").upper() + "\n" + _passage(r, r.randint(0, 30))
        rows.append((100 + i, text))
    rows += [(500, items[-1][1] + "X"), (501, items[-1][1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' segment", "'y' item", "'z' items")
    benchmark = spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS_DDL)
    found = decontamination.contamination(documents, benchmark, segment_words=500, block_chars=300)
    digest = decontamination.contamination_digest(found).collect()
    wanted = Counter((i, *contamination(t, items)) for i, t in rows)
    assert Counter(tuple(x)[:6] for x in digest) == wanted
    assert sum(x.contaminated for x in digest) > 20
    kept = decontamination.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    clean = Counter((i, t) for i, t in rows if not contamination(t, items)[4])
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == clean


def test_empty_benchmark_and_empty_documents(spark):
    documents = frame(spark)
    benchmark = spark.createDataFrame([], ITEMS_DDL)
    found = decontamination.contamination(documents, benchmark)
    assert not any(r.n_hit or r.n_items or r.contaminated for r in found.collect()) and found.count() == len(ODD)
    assert decontamination.drop_contaminated(documents, benchmark).count() == len(ODD)
    assert decontamination.contamination(documents.limit(0), benchmark).count() == 0


def test_proximity_matches(spark):
    item = " ".join(f"q{i}" for i in range(13))
    added, swapped = item.replace("q6", "q6 extra"), item.replace("q6 q7", "q7 q6")
    far = item.replace("q6", "q6 one two three")
    rows = [(1, item), (2, f"so {added} on"), (3, swapped), (4, far), (5, item.replace("q6 ", ""))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(documents, benchmark).collect()}
    assert found[1].n_hit == 13
    assert all(found[i].n_hit == 0 for i in (2, 3, 4, 5))
    assert found[2].n_near and found[3].n_near and not found[4].n_near and not found[5].n_near


RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("Example.com", "/de/", "block"),
    ("example.com", "/de/x", "allow"),
    ("example.com", "/", "allow"),
    ("example.com", "/", "block"),
    ("org", None, "block"),
    (None, "/", "block"),
    ("com", "/", "maybe"),
]


def _plain_verdict(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for h, p, v in rules:
        if h is None or v not in ("allow", "block"):
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h), len(p), v == "block", h + p, v))
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filter_equals_the_rules(spark):
    r = random.Random(6)
    hosts = ["a.net", "net", "xnet", "example.net", "B.Example.NET", "example.com", "www.example.com", "org", "é.org", "", "net.", "net:80", "u@net"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/de/", "/de/x", "/de/xy/z", "/de//x", "//", "/fr/é"]
    urls = ["http://" + h + p + r.choice(["", "?a=/en/", "#x://y"]) for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr(
        "*", "'x' as _row", "'x' as host", "'x' as path", "'x' as h", "'x' as p", "'x' as url_filter"
    )
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for most in (url_filter.MOST_BROADCAST_CHARS, 0):
        found = url_filter.filter_urls(pages, rules, most_broadcast_chars=most)
        assert found.columns == pages.columns
        got = {x.page_id: tuple(x.url_filter) for x in found.collect()}
        assert got == {i: _plain_verdict(u) for i, u in enumerate(urls)}
    none = url_filter.filter_urls(pages, rules.limit(0), default="block").collect()
    assert {x.url_filter.verdict for x in none} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_trigram_queries_follow_from_the_regexes():
    assert secrets.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secrets.trigram_query("ab") == secrets.ANY == secrets.trigram_query("[a-z]+abc?") == secrets.trigram_query("(abc)*")
    assert secrets.trigram_query("(?i)TOK(en|ens)x+") == ("and", (("or", (("and", ("tok", "oke", "ken")), ("and", ("tok", "oke", "ken", "ens")))),))
    assert secrets.trigrams(secrets.trigram_query("x(abc|def)+y")) >= {"abc", "def"}
    assert secrets.Rule("hex", "[0-9a-f]{24,}").query == secrets.ANY


def _satisfied(query, text):
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(_satisfied(q, text) for q in query[1])


SECRETS = [
    "password=hunter22", "PASSWD : 'abcdef'", 'Token = "a1b2c3d4"', "api_key:abcdef", "apikey=  x/+=._-", "secret=short", "secret=tiny!",
    "token=token=abcdefgh", "secret: token:abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 15, "AKIA" + "A" * 15, "ab" * 12, "f" * 23,
    "0123456789abcdef" * 3, "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "password=", "to\u212aen=abcdefgh",
]


@pytest.mark.parametrize("rule", secrets.BASE_RULES + secrets.MORE_RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_query(rule):
    for text in SECRETS:
        if secrets.plain_matches(text, rule):
            assert _satisfied(rule.query, text.lower())


def test_secrets_equal_plain_regexes(spark):
    r = random.Random(7)
    rows = [(i, t) for i, t, *_ in ODD]
    for i in range(120):
        parts = [r.choice([*SECRETS, "é words 你 \U0001f600", "deadbeef and", "\n", "  "]) for _ in range(r.randint(0, 8))]
        rows.append((100 + i, r.choice([" ", "é", ""]).join(parts)))
    rows += [(900, " ".join(["password=abcdef12"] * 500)), (900, " ".join(["password=abcdef12"] * 500))]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' hash", "'x' kinds", "'x' spans", "'x' _hash")
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    found = secrets.secrets_digest(secrets.find_secrets(documents)).collect()

    def plain(text):
        ascii_rules = [replace(rule, pattern=rule.pattern.replace("(?i)", "(?ai)")) for rule in rules]
        of = [(a, k, f"{rule.kind}:{a}:{b}") for k, rule in enumerate(ascii_rules) for a, b in secrets.plain_matches(text or "", rule)]
        return ",".join(s for _, _, s in sorted(of)), tuple(sum(k == n for _, k, _ in of) for n in range(3))

    wanted = Counter((i, *plain(t)) for i, t in rows)
    assert Counter((x.doc_id, x.spans, (x.n_assign, x.n_access, x.n_hex)) for x in found) == wanted
    assert secrets.find_secrets(documents.limit(0)).count() == 0
    only = secrets.find_secrets(documents, [secrets.BASE_RULES[2]]).selectExpr("sum(size(spans)) n").first().n
    assert only == sum(n[2][2] * c for n, c in wanted.items())


def test_many_matches_in_one_text_cost_in_proportion(spark):
    """32,000 matches take some four times 8,000, and stand where the regex finds them."""
    rule, took = secrets.BASE_RULES[0], {}
    for n in (8, 8_000, 32_000):
        text = "".join(f"é token=abcdef{i} " for i in range(n))
        documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.perf_counter()
        (row,) = secrets.find_secrets(documents, [rule]).collect()
        took[n] = time.perf_counter() - started
        assert [(s.start, s.end) for s in row.spans] == secrets.plain_matches(text, rule)
    assert took[32_000] - took[8] < 8 * max(took[8_000] - took[8], 1.0)


def test_running_sums(spark):
    rows = [(0, []), (1, [5]), (2, list(range(100))), (3, None)]
    frame = spark.createDataFrame(rows, "id int, of array<int>")
    items = F.transform("of", lambda x: F.struct(x.alias("n"), F.lit("k").alias("name")))
    found = {r.id: r.sums for r in frame.select("id", with_running_sum(items, "n", ["n", "name"]).alias("sums")).collect()}
    for number, of in rows:
        assert found[number] == (None if of is None else [(sum(of[: i + 1]), "k") for i in range(len(of))])


def test_license_notices_in_odd_and_altered_texts(spark):
    apache, bsd = licenses.NOTICES["apache-2.0"], licenses.NOTICES["bsd"]
    altered = bsd.replace("are met", "were met")
    rows = [(i, t) for i, t, *_ in ODD] + [
        (100, f"so {apache.upper()} and"),
        (101, "Licensed  under\nthe Apache (License) version 2 0"),
        (102, "Licensed under the Apache"),
        (103, "x " * 3000 + altered + " y" * 3000 + " " + apache),
        (104, bsd.replace("source and binary", "any").replace("permitted provided", "fine")),
        (105, apache),
        (105, apache),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' id", "'x' license", "'x' words", "'x' places")
    found = {(r.doc_id, r.license): r for r in licenses.find_licenses(documents).collect()}
    assert set(found) == {(100, "apache-2.0"), (101, "apache-2.0"), (103, "apache-2.0"), (103, "bsd"), (105, "apache-2.0")}
    assert found[100, "apache-2.0"].containment == 1.0 and found[103, "bsd"].containment < 0.95
    assert abs(found[103, "bsd"].first_word - 3000) < 8
    assert licenses.find_licenses(documents.limit(0)).count() == 0
    assert licenses.find_licenses(documents, {}).count() == 0


def test_license_bands_and_anchors():
    for text in licenses.NOTICES.values():
        words = licenses.template_words(text)
        shingles, anchors = licenses.shingle_list(words), licenses.anchors(words)
        bare = sum(anchors.isdisjoint(s.split()) for s in set(shingles))
        assert bare < licenses.CONTAINMENT * len(set(shingles))
        size = licenses.WindowClass(len(words))
        own, wide = len(words) - 4, size.length - 4
        shared = -(-own * 4 // 5)
        alike = shared / (own + wide - shared)
        assert (1 - alike**licenses.BAND_ROWS) ** size.bands <= 1 - licenses.FOUND_CHANCE + 1e-12


def _region_containment(words, template):
    own = set(licenses.shingle_list(template))
    return len(own & set(licenses.shingle_list(words))) / len(own)


@pytest.mark.parametrize("name", ["mit-grant", "gpl-header", "apache-2.0-header", "mit-text"])
def test_no_notice_is_lost_by_its_place(spark, name):
    """Words inserted at one place of a notice, at every offset to the grid of windows."""
    template = licenses.template_words(licenses.NOTICES[name])
    size, rows, wanted = licenses.WindowClass.of(len(template)), [], set()
    for inserted in (0, 3, 5, size.allowance):
        for cut in (1, len(template) // 2):
            altered = template[:cut] + ["added"] * inserted + template[cut:]
            for offset in range(size.stride):
                for start in (offset, licenses.CHUNK_WORDS - len(template) // 2 + offset):
                    rows.append((len(rows), " ".join(["x"] * start + altered + ["y"] * 300)))
                    if _region_containment(altered, template) >= licenses.CONTAINMENT:
                        wanted.add(rows[-1][0])
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r for r in licenses.find_licenses(documents, {name: licenses.NOTICES[name]}).collect()}
    assert len(wanted) >= len(rows) // 2 and len(wanted - set(found)) <= 0.002 * len(wanted)
    for doc_id, r in found.items():
        asked, shown = licenses.shingle_list(template), licenses.shingle_list(rows[doc_id][1].split())
        assert r.first_word == next(i for i, s in enumerate(shown) if s in asked)


def test_altered_notices_are_found_as_by_plain_windows(spark):
    """Recall on notices with words left out, replaced and inserted, against every stretch of the allowed length."""
    r = random.Random(9)
    names = ["bsd", "gpl-header", "isc-text", "mpl-2.0", "mit-licensed", "zlib-text", "cc0-waived", "epl-2.0"]
    templates = {name: licenses.template_words(licenses.NOTICES[name]) for name in names}
    rows, wanted = [], set()
    for i in range(400):
        name = names[i % len(names)]
        words = list(templates[name])
        for _ in range(r.randint(0, 1 + len(words) // 25)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["other"], [words[at], "more", "words"]])
        text = [f"w{r.randrange(90)}" for _ in range(r.randint(0, 200))] + words + [f"w{r.randrange(90)}" for _ in range(50)]
        rows.append((i, " ".join(text)))
        for own, template in templates.items():
            most = len(template) + licenses.WindowClass.of(len(template)).allowance
            if any(_region_containment(text[k : k + most], template) >= licenses.CONTAINMENT for k in range(max(1, len(text) - most + 1))):
                wanted.add((i, own))
    found = {(x.doc_id, x.license) for x in licenses.find_licenses(
        spark.createDataFrame(rows, "doc_id long, text string"), {n: licenses.NOTICES[n] for n in names}).collect()}
    assert len(wanted) > 150 and len(wanted - found) <= 0.002 * len(wanted)


def test_parts_of_a_template_set_find_the_same(spark):
    texts = [*licenses.NOTICES.values(), " ".join(licenses.NOTICES.values()), "license " * 9000 + licenses.NOTICES["isc-text"]]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, cut = (Counter(licenses.find_licenses(documents, part_words=n).collect()) for n in (licenses.PART_WORDS, 400))
    assert whole == cut and {r.license for r in whole if r.doc_id == len(licenses.NOTICES)} == set(licenses.NOTICES)
    assert any(r.doc_id == len(texts) - 1 and r.license == "isc-text" and r.containment == 1.0 for r in whole)
    worded = {name: licenses.template_words(text) for name, text in licenses.NOTICES.items()}
    assert 3 < len(licenses.parts_of(worded, 400)) < 15 and sum(len(p.templates) for p in licenses.parts_of(worded, 400)) == len(worded)
