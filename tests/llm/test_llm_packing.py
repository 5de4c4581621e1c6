from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import ODD, frame
from tokenizers import Tokenizer

from tillwise.llm import packing
from tillwise.llm.queries import vocabulary_path
from tillwise.llm.tokens import encoder

TESTDATA = "/root/testdata"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


ODD_TEXTS = ["", " ", "  a", "a  b", " a", "a ", "a\n\n b", "x <|endoftext|> y", "é  b", "a \x1c b c", "tab\t x", "it's", "a 　b", "\U0001f600"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_are_those_of_tokenizers(tokenizer, text):
    assert encoder(vocabulary_path()).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 3)
    assert [bins.place(n) for n in (7, 5, 6)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.place(4) == (2, 6)  # free are 3, 5, 4: the four fill the third bin
    assert bins.place(3) == (0, 7)
    assert bins.place(6) == (3, 0) and bins.place(9) == (4, 0)  # open: 5, 4 and 1 free
    assert bins.place(8) == (5, 0)  # the bin with 1 free closes
    assert bins.place(1) == (5, 8) and bins.place(1) == (5, 9)


def test_best_fit_never_overfills_and_wastes_little():
    random.seed(1)
    sizes = [random.randint(1, 700) for _ in range(5000)]
    bins, filled = packing.BestFit(1024, 64), defaultdict(int)
    for n in sizes:
        number, offset = bins.place(n)
        assert offset == filled[number]
        filled[number] += n
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.05 * sum(sizes) / 1024 + 64


def _check(found, texts, tokenizer, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, own in texts.items():
        wanted = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in own)
        pieces = sorted(by_doc.pop(key), key=lambda r: (r.piece, r.start))
        if len(own) == 1:
            assert [r.piece for r in pieces] == list(range(len(pieces)))
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == wanted[0]
            assert all(r.length == capacity for r in pieces[1:])
        assert sum(r.length for r in pieces) == sum(map(len, wanted))
    assert not by_doc
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_round_trip_of_odd_rows(spark, tokenizer):
    texts = defaultdict(list)
    for doc_id, text, *_ in ODD:
        texts[doc_id].append(text)
    _check(packing.pack(frame(spark), vocabulary_path()).collect(), texts, tokenizer)
    assert packing.pack(frame(spark).limit(0), vocabulary_path()).count() == 0


def test_round_trip_of_a_whole_table(spark, tokenizer):
    documents = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: [r.text] for r in documents.collect()}
    found = packing.pack(documents.repartition(3), vocabulary_path()).collect()
    _check(found, texts, tokenizer)
    tokens = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= tokens / 1024 + 3 * 8


BLANKS = {"blanks": " ", "ends": "\n", "tabs": "\t", "mixed": " \n\t \r　"}


@pytest.mark.parametrize("kind", sorted(BLANKS))
def test_long_white_space_is_packed(spark, kind):
    """A million blanks of each kind, alone and inside of words, in the encoder and through ``pack``."""
    run = (BLANKS[kind] * 1_000_000)[:1_000_000]
    texts = [run, f"a{run}b", f"some words {run}and more", "short"]
    plain = Tokenizer.from_file(vocabulary_path())
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder(vocabulary_path()).encode(t).tolist() for t in texts] == wanted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pack(docs, vocabulary_path()).orderBy("doc_id", "piece").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert [got[i] for i in range(len(texts))] == [ids + [packing.END_OF_TEXT] for ids in wanted]


def test_files_with_other_splits_are_left_to_their_library(tmp_path):
    import json

    content = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    for change in ({"pre_tokenizer": content["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(content | change), encoding="utf-8")
        plain = Tokenizer.from_file(str(path))
        from tillwise.llm.tokens import Encoder

        for text in ("Hello World", " x", "ABC def\n\n"):
            assert Encoder(str(path)).encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_bins_are_those_of_a_plain_best_fit():
    dice = random.Random(6)
    for capacity, most in ((1024, 512), (100, 8), (10, 1)):
        bins, free, made = packing.BestFit(capacity, most), [], 0
        for _ in range(5000):
            length = dice.randrange(1, capacity + 1)
            fitting = [f for f in free if f >= length]
            if fitting:
                space = min(fitting)
                free.remove(space)
            else:
                if len(free) >= most:
                    free.remove(min(free))
                space, made = capacity, made + 1
            if space > length:
                free.append(space - length)
            number, offset = bins.place(length)
            assert offset == capacity - space and number < made
