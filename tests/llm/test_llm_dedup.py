from __future__ import annotations

import random
from collections import Counter

import numpy as np
from llm_cases import ODD, exact_groups, frame, linked_classes, same_text, simhash

from tillwise.llm import dedup_exact, simhash as near
from tillwise.llm.components import connected_components


def _check_exact(found, rows):
    groups = exact_groups(rows)
    by_sha = {sha: (keep, size) for keep, size, sha in groups.values()}
    assert len(found) == len(rows)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in found)
    assert Counter(r.text_sha256 for r in found if r.kept) == dict.fromkeys(by_sha, 1)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    wanted = Counter((i, groups[same_text(t)][2]) for i, t in rows)
    assert Counter((r.doc_id, r.text_sha256) for r in found) == wanted


def test_exact_copies_of_odd_rows(spark):
    _check_exact(dedup_exact.exact_duplicates(frame(spark)).collect(), [r[:2] for r in ODD])
    assert dedup_exact.exact_duplicates(frame(spark).limit(0)).count() == 0


def test_exact_copies_of_a_hot_text_span_ranges(spark):
    rows = [(i, "hot text " + " " * (i % 3) if i % 3 else f"text number {i % 50}") for i in range(3000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dedup_exact.exact_duplicates(documents)
    _check_exact(found.collect(), rows)


def test_dropping_copies_keeps_rows_as_they_are(spark):
    documents = frame(spark)
    kept = dedup_exact.drop_copies(documents)
    assert kept.columns == documents.columns
    texts = [same_text(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({same_text(r[1]) for r in ODD})
    assert {r.doc_id for r in kept.collect() if same_text(r.text) == "Sametexthere"} == {5}
    assert dedup_exact.drop_copies(documents.limit(0)).count() == 0


def test_fingerprints_equal_the_definition():
    texts = [r[1] for r in ODD] + ["One", "one two", "ONE two three", "a b c d " * 300, " ".join(map(str, range(999)))]
    assert [near.fingerprint(t) for t in texts] == [simhash(t) for t in texts]


def test_trie_walk_finds_every_pair():
    random.seed(3)
    centres = [random.getrandbits(64) for _ in range(20)]
    values = {c for c in centres}
    for c in centres:
        for _ in range(60):
            values.add(c ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 4))))
    values |= {0, (1 << 64) - 1, 1, 3, 7}
    ordered = np.array(sorted(values), dtype=np.uint64)
    found = set()
    for left, right in near.trie_links(ordered, (0, len(ordered), 0, len(ordered)), 0, 63, 2):
        found |= {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}
    plain = ordered.tolist()
    wanted = {(i, j) for i in range(len(plain)) for j in range(i + 1, len(plain)) if (plain[i] ^ plain[j]).bit_count() <= 2}
    assert found == wanted and len(wanted) > 500


def test_links_over_nodes_of_the_trie(spark, monkeypatch):
    monkeypatch.setattr(near, "NODE_MEAN", 8)
    random.seed(4)
    values = set()
    for _ in range(25):
        c = random.getrandbits(64)
        values |= {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for _ in range(12)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = near.near_links(spark.createDataFrame(signed, "fp long"))
    classes, links = linked_classes(values)
    degree = Counter()
    for r in found.collect():
        degree[r.fp % (1 << 64)] += r.links
    assert degree == {v: n for v, n in links.items() if n}
    roots = {r.node % (1 << 64): r.root for r in connected_components(found.selectExpr("fp a", "root b")).collect()}
    for v, name in classes.items():
        for w, other in classes.items():
            if links[v] and links[w]:
                assert (name == other) == (roots.get(v, v if v < 1 << 63 else v - (1 << 64)) == roots.get(w, w if w < 1 << 63 else w - (1 << 64)))


def test_near_copies_of_odd_rows_and_a_hot_group(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, t) for i, t, *_ in ODD]
    rows += [(100 + i, base if i % 2 else base.replace(f"word{i % 40} ", "new ", 1)) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "'y' as low", "'z' as root")
    found = near.near_duplicates(documents).collect()
    classes, links = linked_classes([simhash(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            name = classes[simhash(t)]
            least[name] = min(least.get(name, i), i)
    assert max(links.values()) > 3
    wanted = Counter((i, simhash(t), least.get(classes[simhash(t)]), links[simhash(t)]) for i, t in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id, r.n_links) for r in found) == wanted
    kept = near.drop_near_copies(documents)
    assert kept.columns == documents.columns
    stays = kept.collect()
    assert sorted(classes[simhash(r.text)] for r in stays) == sorted(set(classes.values()))
    assert all(r.doc_id == least.get(classes[simhash(r.text)]) for r in stays)
    assert near.near_duplicates(documents.limit(0)).count() == 0
    assert near.drop_near_copies(documents.limit(0)).count() == 0
