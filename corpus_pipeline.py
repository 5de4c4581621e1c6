"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, with their columns unchanged, and the last
returns the pieces of the packed sequences. The stages share their operators and parameters with the
queries of ``tillwise.llm.queries``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import decontamination, dedup_exact, packing, simhash, toxicity
from tillwise.llm import queries as llm
from tillwise.sources.shared import Tables, current, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold, under a model of these documents and the labels."""
    model = toxicity.fit(docs, llm.toxicity_labels(spark, sf_dir))
    return toxicity.drop_rejected(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    return dedup_exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontamination.drop_contaminated(docs, llm.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences."""
    return packing.packing_digest(packing.pack(docs, llm.vocabulary_path()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The first stage is a trained model, so no SQL gives the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared folder and read again.

    What a stage's operator stages goes when the stage is written, and a stage's documents when the next one's are.
    """
    docs, owner, before = llm.table(spark, sf_dir, "documents"), current(spark), None
    for name, apply in STAGES[:-1]:
        key = (name, uuid.uuid4())
        with Tables(spark):
            docs = owner.made(key, f"pipeline_{name}", lambda path, apply=apply, docs=docs: written(apply(spark, docs, sf_dir), path))
        owner.drop(before)
        before = key
    return STAGES[-1][1](spark, docs, sf_dir)
