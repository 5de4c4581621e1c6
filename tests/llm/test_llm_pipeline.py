"""The pipeline and the queries with SQL, over whole tables."""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from llm_cases import ODD, contamination, exact_groups, frame, linked_classes, same_text, simhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tillwise.llm import chat, queries, toxicity
from tillwise.sources import Tables, shared_folder

SF_DIR = os.environ.get("TILLWISE_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = queries.queries()[name](spark, SF_DIR)
    expected = connection.execute(queries.oracle_sql()[name])
    assert {c: SQL_TYPES[t] for c, t in found.dtypes} == {d[0]: str(d[1]) for d in expected.description}
    columns = [d[0] for d in expected.description]
    wanted = sorted(repr(r) for r in expected.fetchall())
    assert wanted and sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == wanted


def test_registry_has_every_operator_and_the_pipeline():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.ROOT)
    for path in [*root.glob("tillwise/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_every_stage_equals_a_plain_version(spark, tmp_path):
    """Each stage on what the one before kept, against plain code; the first against its own scores."""
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = [(10_000 + i, docs.first().text, "en", "s", 1) for i in range(40)]
    more += [(20_000 + i, items[0][1], "en", "s", 1) for i in range(3)] + [(30_000, None, None, None, None), (30_001, "", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for number, (name, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
            assert len(after) == out.count() and after.items() <= kept.items()
        if number == 0:
            model = toxicity.fit(docs, queries.toxicity_labels(spark, SMALL))
            assert set(after) == {i for i, t in kept.items() if model.score(t, {}) < toxicity.REJECTED}
        elif number == 1:
            groups = exact_groups(kept.items())
            assert set(after) == {groups[same_text(t)][0] for t in kept.values()} and len(after) < len(kept) - 30
        elif number == 2:
            classes, _ = linked_classes([simhash(t) for t in kept.values()])
            least = defaultdict(list)
            for i, t in kept.items():
                least[classes[simhash(t)]].append(i)
            assert set(after) == {min(ids) for ids in least.values()}
        elif number == 3:
            assert set(after) == {i for i, t in kept.items() if not contamination(t, items)[4]} and len(after) < len(kept)
        else:
            lengths = Counter()
            for r in out.collect():
                lengths[r.doc_id] += r.length
            tokenizer = Tokenizer.from_file(queries.vocabulary_path())
            assert lengths == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
        docs, kept = out, after


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = frame(spark)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, SMALL).columns == docs.columns
        assert apply(spark, docs.limit(0), SMALL).count() == 0
    _, pack = corpus_pipeline.STAGES[-1]
    assert pack(spark, docs, SMALL).select("doc_id").distinct().count() == len({r[0] for r in ODD})
    assert pack(spark, docs.limit(0), SMALL).count() == 0


def test_the_pipeline_keeps_its_last_documents_alone(spark):
    folder = Path(shared_folder(spark))
    outside = set(folder.glob("*"))
    with Tables(spark):
        packed = corpus_pipeline.run(spark, SMALL)
        assert [p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - outside] == ["pipeline_benchmark_decontamination"]
        assert packed.count() > 0
    assert set(folder.glob("*")) == outside


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more?"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more?"), (2, 3, "assistant", "no é\U0001f600"), (2, 4, "user", "bye"),
    (3, 0, "user", "hi"), (3, 0, "user", "hi"),
    (4, 1, None, None), (4, None, "system", "be kind"),
    (5, 0, "user", "hi"), (5, 1, "assistant", "hello"), (5, 2, "user", "more?"), (5, 3, "assistant", "no é\U0001f600"), (5, 4, "user", "bye"),
    (None, 0, "user", "lost"), (9000, 0, "user", "hi"), (9000, 1, "assistant", ""),
]


def test_preference_records_of_odd_conversations(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' turns", "'y' t", "'z' bucket")
    talks = chat.whole_conversations(turns)
    assert {r.conv_id: len(r.turns) for r in talks.collect()} == {1: 4, 2: 5, 3: 1, 4: 2, 5: 5, 9000: 2}
    found = {(r.chosen_id, r.rejected_id): r for r in chat.preference_records(chat.opening_pairs(talks)).collect()}
    assert set(found) == {(1, 2), (2, 3), (3, 5), (5, 9000)}
    first = found[1, 2]
    assert first.prompt == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore?\n" and first.prompt_turns == 3
    assert first.chosen_text == "<|assistant|>\nyes\n" and first.chosen_mask == "14:18"
    assert first.rejected_text == "<|assistant|>\nno é\U0001f600\n<|user|>\nbye\n" and first.rejected_mask == "14:20"
    assert found[2, 3].rejected_text == "" and found[2, 3].rejected_mask == "" and found[2, 3].prompt_turns == 1
    swapped = {(r.chosen_id, r.rejected_id): r for r in chat.preference_records(chat.swapped_reply_pairs(talks)).collect()}
    assert set(swapped) == {(2, 1), (5, 2), (9000, 5)}
    assert swapped[2, 1].rejected_text == "<|assistant|>\nyes\n" and swapped[2, 1].prompt_turns == 3
    assert swapped[5, 2].prompt_turns == 4 and swapped[5, 2].chosen_text == swapped[5, 2].rejected_text == ""
    empty = chat.whole_conversations(turns.limit(0))
    assert chat.preference_records(chat.opening_pairs(empty)).count() == 0
    assert chat.preference_records(chat.swapped_reply_pairs(empty)).count() == 0
    bare = chat.opening_pairs(talks).withColumn("chosen", F.lit(None).cast(talks.schema["turns"].dataType))
    assert {(r.prompt, r.chosen_text) for r in chat.preference_records(bare).collect()} == {("", "")}


def test_pairs_do_not_depend_on_the_bucket(spark):
    rows = [(i, 0, "user", f"opening {i % 3 if i % 4 else 0}") for i in range(0, 3000, 7)]
    talks = chat.whole_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pairs = [Counter((r.chosen_id, r.rejected_id) for r in chat.opening_pairs(talks, b).collect()) for b in (1, 64, 10_000)]
    assert pairs[0] == pairs[1] == pairs[2] and sum(pairs[0].values()) == len(rows) - 3


def test_pairs_of_text_and_sparse_ids(spark):
    ids = {"string": [f"c{i * 7919 % 1000:03d}" for i in range(300)], "long": [(i * 0x9E3779B97F4A7C15 & (1 << 62) - 1) for i in range(300)]}
    for kind, names in ids.items():
        rows = [(c, 0, "user", f"opening {i % 3 if i % 4 else 0}") for i, c in enumerate(names)]
        rows += [(c, 1, "assistant", f"reply {i}") for i, c in enumerate(names) if i % 5]
        talks = chat.whole_conversations(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string"))
        opening, answered = dict((r[0], r[3]) for r in rows if r[1] == 0), sorted(r[0] for r in rows if r[1] == 1)
        wanted = set()
        for text in set(opening.values()):
            own = sorted(c for c in names if opening[c] == text)
            wanted |= set(zip(own, own[1:]))
        for range_rows in (20, chat.RANGE_ROWS):
            found = [(r.chosen_id, r.rejected_id) for r in chat.opening_pairs(talks, range_rows).collect()]
            assert len(found) == len(wanted) and set(found) == wanted
            swapped = [(r.chosen_id, r.rejected_id) for r in chat.swapped_reply_pairs(talks, range_rows=range_rows).collect()]
            assert sorted(swapped) == list(zip(answered[1:], answered))


def test_windows_over_ranges_see_one_row_each(spark):
    """The only window without a key runs over the ends of ranges."""
    rows = spark.range(2000).selectExpr("id * 1000003 as conv_id", "'same' as opening")
    pairs = chat._predecessors(rows, ["opening"], 100)
    assert sorted((r.before, r.conv_id) for r in pairs.collect()) == [(i * 1000003, (i + 1) * 1000003) for i in range(1999)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    keyless = plan[plan.index("windowspecdefinition(part") :]
    assert "Aggregate [part" in keyless and plan.count("windowspecdefinition(part#") == 2
