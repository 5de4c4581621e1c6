from __future__ import annotations

import math
import random
import zlib

import numpy as np
from llm_cases import ODD, frame
from pyspark.sql import functions as F

from tillwise.llm import language, linear, queries, toxicity

TESTDATA = "/root/testdata"


def test_leader_recovers_a_sparse_separator():
    r = np.random.default_rng(0)
    xs, truth = [], []
    for _ in range(1500):
        seen = np.sort(r.choice(200, 12, replace=False))
        xs.append((seen, np.ones(12)))
        low, high = (seen < 8).any(), (seen >= 192).any()
        truth.append(1 if low else 2 if high else 0)
    truth = np.array(truth)
    weights = linear.train(xs[:1000], np.eye(3)[truth[:1000]], 200, linear.Penalties(alpha=0.5, l1=1.0, l2=0.1, epochs=6))
    scores = np.array([v @ weights[s] + weights[-1] for s, v in xs[1000:]])
    assert (scores.argmax(axis=1) == truth[1000:]).mean() > 0.97
    heavier = linear.train(xs[:1000], np.eye(3)[truth[:1000]], 200, linear.Penalties(alpha=0.5, l1=8.0, l2=0.1, epochs=6))
    assert (weights[8:192] == 0).mean() < 0.5 < (heavier[8:192] == 0).mean()
    assert not linear.train([], np.zeros((0, 3)), 5, linear.Penalties(1.0, 1.0, 1.0)).any()


def test_temperature_undoes_overconfidence():
    r = np.random.default_rng(1)
    scores = r.normal(size=(4000, 4))
    chances = linear.softmax(scores)
    truth = np.array([r.choice(4, p=p) for p in chances])
    assert abs(math.log(linear.temperature(scores * 3, truth) / 3)) < 0.15
    assert linear.temperature(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


def test_languages_of_held_out_documents(spark):
    found = queries.op10_language_id(spark, f"{TESTDATA}/sf0.01").join(
        spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    rows = found.collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_languages_of_odd_rows(spark):
    r = random.Random(2)
    texts = {"aa": "abba aab bab", "bb": "xyzzy zyx xxy"}
    rows = [(1000 + i, " ".join(r.choices(texts[lang].split(), k=20)), lang, None, None) for i in range(60) for lang in texts]
    labelled = frame(spark, [*rows, *ODD, (1, "abba aab", None, None, None)])
    model = language.fit(labelled.filter("lang is null or lang in ('aa', 'bb')"))
    assert model.languages == ["aa", "bb"]
    found = frame(spark).select("doc_id", "text", language.predict(F.col("text"), model).alias("p")).collect()
    assert len(found) == len(ODD)
    for x in found:
        if x.text is None or not any(map(str.isalpha, x.text)):
            assert (x.p.lang_pred, x.p.score) == ("und", 0.0)
        else:
            assert x.p.lang_pred in model.languages and 0.5 <= x.p.score <= 1.0
    assert model.predict("aab abba")[0] == "aa" and model.predict("ZYX xxy")[0] == "bb"
    empty = language.fit(labelled.limit(0))
    assert empty.predict("abc") == ("und", 0.0)
    alone = language.fit(labelled.filter("lang = 'aa'"))
    assert alone.predict("abc") == ("aa", 1.0)


def test_label_model_estimates_accuracies_and_follows_copied_voters():
    r = np.random.default_rng(3)
    n = 6000
    truth = (r.random(n) < 0.3).astype(int)
    accuracy = [0.9, 0.8, 0.7, 0.65]
    votes = np.column_stack([np.where(r.random(n) < a, 2 * truth - 1, 1 - 2 * truth) for a in accuracy])
    copied = np.where(r.random(n) < 0.95, votes[:, 1], -votes[:, 1])
    votes = np.column_stack([votes, copied, np.where(r.random(n) < 0.5, 0, votes[:, 0])])
    label = np.where(r.random(n) < 0.9, truth, 1 - truth)
    model, chance = toxicity.fit_label_model(votes, label, np.ones(n))
    assert model.follows[4] == 1 or model.follows[1] == 4
    assert np.abs(model.accuracies()[:4] - accuracy).max() < 0.06
    assert ((chance > 0.5) == truth).mean() > 0.94


def test_scores_of_held_out_documents(spark):
    sf_dir = f"{TESTDATA}/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.8
    assert np.mean([s >= 0.5 for s in clean]) < 0.01
    above = np.mean([[a > b for b in clean] for a in toxic])
    assert above > 0.9


def test_toxicity_of_odd_rows(spark):
    r = random.Random(4)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((1000 + i, " ".join(r.choices(words, k=30) + ["vilest", "rotten"] * bad), None, None, None))
        labels.append((1000 + i, int(bad)))
    labels += [(1, 1), (None, 1), (5000, 1), (1001, None), (1003, 7), (1004, labels[4][1])]
    documents = frame(spark, rows + ODD)
    given = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text", "'y' as y", "'z' as id")
    model = toxicity.fit(documents, given)
    scored = documents.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(scored) == len(rows) + len(ODD)
    for x in scored:
        assert (x.s >= 0.5) == ("vilest" in (x.text or ""))
    kept = toxicity.drop_rejected(documents, model)
    assert kept.columns == documents.columns and kept.count() == len(rows) + len(ODD) - 50
    for none in (toxicity.fit(documents, given.limit(0)), toxicity.fit(documents.limit(0), given)):
        assert none.score("vilest rotten", {}) < 0.5
    assert toxicity.drop_rejected(documents.limit(0), model).count() == 0
