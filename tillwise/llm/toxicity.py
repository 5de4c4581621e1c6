"""Toxicity scores by weak supervision.

Many weak voters look at a document: lexicons of words and word stems, and patterns of spelling and of
how densely the lexicons hit. A generative label model estimates how accurate each voter is and which
voters follow each other (a tree of the strongest dependences), from their votes and a labelled
sample whose label is one more fallible voter. A linear classifier is then trained on the model's
posterior labels and scores whole texts.

The lexicons are mined from the labelled sample: terms far commoner in toxic documents. The sample
is bounded per label; scoring reads every document once and needs no shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.linear import Penalties, train
from tillwise.sources.shared import staged

#: Labelled rows that are learned from, at most, by label.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: Terms: how many at most, in how many toxic documents at least (a number and a share), least log odds.
#: The share keeps out words that single groups of near copies repeat.
TERMS, LEAST_DOCUMENTS, LEAST_SHARE, LEAST_ODDS = 1000, 5, 0.02, 3.0
#: Score from which a document is rejected.
REJECTED = 0.5
STEMS = (4, 5, 6, 7, 8)
LEXICONS = 12
ROUNDS = 15
LINK_NATS = 0.01
#: Rows, as a share of all, that the prior of the label voter is worth.
LABEL_WORTH = 0.5
PENALTIES = Penalties(alpha=0.5, l1=0.3, l2=0.3, epochs=5)
KNOWN_WORDS = 200_000
_FINE = 1 << 30

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"(?:\b[A-Z]{3,}\b[^\w\n]*){4}")
_MARKS = re.compile(r"([!?$%&*#@])\1{2,}|!!")
_MASKED = re.compile(r"[A-Za-z][*@#$]{2,}[A-Za-z]")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, which end in a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def _patterns(text: str) -> list[int]:
    """Votes of the spelling patterns: toxic, or none."""
    return [int(bool(p.search(text))) for p in (_SHOUT, _MARKS, _MASKED)]


def votes(text: str | None, lexicon_of: dict[str, int]) -> list[int]:
    """Votes 1 toxic, -1 clean, 0 none: of each lexicon, of the hits' number and density, of the patterns."""
    found = words(text)
    hit_words = [w for w in found if any(t in lexicon_of for t in terms_of(w))]
    hit = {lexicon_of[t] for w in hit_words for t in terms_of(w) if t in lexicon_of}
    n = len(hit_words)
    dense = n / max(1, len(found))
    counts = [1 if n else -1, 1 if n > 1 else -1 if not n else 0, 1 if n > 2 else 0, 1 if dense > 0.01 else -1 if dense < 0.001 else 0]
    return [int(k in hit) for k in range(LEXICONS)] + counts + _patterns(text or "")


@dataclass(frozen=True)
class LabelModel:
    """P(y) and, for each voter, P(vote | y, vote of the voter it follows); votes are coded 0, 1, 2."""

    prior: np.ndarray
    tables: list[np.ndarray]
    follows: list[int]

    def posterior(self, coded: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        log = np.tile(np.log(self.prior), (len(coded), 1))
        for j, (table, parent) in enumerate(zip(self.tables, self.follows, strict=True)):
            above = coded[:, parent] if parent >= 0 else np.zeros(len(coded), int)
            log += np.log(table[:, above, coded[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        chances = np.exp(log)
        return chances[:, 1] / chances.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """How often each voter is right when it votes, at the model's class balance."""

        def chances(j: int) -> np.ndarray:
            """P(vote | y), with the voter that it follows summed out."""
            parent = self.follows[j]
            return self.tables[j][:, 0] if parent < 0 else np.einsum("yp,ypv->yv", chances(parent), self.tables[j])

        joint = [chances(j) * self.prior[:, None] for j in range(len(self.tables))]
        return np.array([(c[0, 0] + c[1, 2]) / max(1e-12, c[:, [0, 2]].sum()) for c in joint])


def _tree(coded: np.ndarray, chance: np.ndarray) -> list[int]:
    """The voter each one follows, or -1: a maximum spanning forest of dependence within the classes."""
    m, weight = coded.shape[1], np.stack([1 - chance, chance])
    total = weight.sum()
    seen = [[(coded[:, j] == v).astype(float) for v in range(3)] for j in range(m)]
    links = []
    for i in range(m):
        for j in range(i + 1, m):
            nats = 0.0
            for w in weight:
                joint = np.array([[(w * a * b).sum() for b in seen[j]] for a in seen[i]]) + 1e-9
                joint /= joint.sum()
                apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                nats += w.sum() / total * (joint * np.log(joint / apart)).sum()
            if nats > LINK_NATS:
                links.append((nats, i, j))
    group, beside = list(range(m)), [[] for _ in range(m)]
    for _, i, j in sorted(links, reverse=True):
        if group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
            beside[i].append(j)
            beside[j].append(i)
    follows, done = [-1] * m, set()
    for root in range(m):
        todo = [] if root in done else [root]
        done |= set(todo)
        while todo:
            i = todo.pop()
            for j in beside[i]:
                if j not in done:
                    follows[j] = i
                    done.add(j)
                    todo.append(j)
    return follows


def fit_label_model(found: np.ndarray, label: np.ndarray, importance: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The model and P(toxic) of each row, by expectation maximisation that starts from the labels.

    The label votes as the last voter, with a prior that it is mostly right.
    """
    coded = np.column_stack([found, 2 * label - 1]) + 1
    chance = np.where(label == 1, 0.95, 0.05)
    last = coded.shape[1] - 1
    model = None
    for _ in range(ROUNDS):
        follows = _tree(coded, np.clip(chance, 1e-6, 1 - 1e-6) * 1.0)
        follows = [-1 if j == last else parent for j, parent in enumerate(follows)]
        follows = [-1 if parent == last else parent for parent in follows]
        tables = []
        for j, parent in enumerate(follows):
            table = np.full((2, 3, 3), 0.5)
            above = coded[:, parent] if parent >= 0 else np.zeros(len(coded), int)
            for y, share in enumerate((1 - chance, chance)):
                np.add.at(table[y], (above, coded[:, j]), share * importance)
            if j == last:
                extra = LABEL_WORTH * importance.sum() / 2
                table[0, 0] += extra * np.array([0.95, 0.0, 0.05])
                table[1, 0] += extra * np.array([0.05, 0.0, 0.95])
            tables.append(table / table.sum(axis=2, keepdims=True))
        toxic = float((chance * importance).sum() / importance.sum())
        model = LabelModel(np.array([1 - toxic, toxic]).clip(1e-4), tables, follows)
        chance = model.posterior(coded)
    return model, chance


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of terms, the intercept, and the label model that the weights were trained under."""

    weights: dict[str, float]
    intercept: float
    labels: LabelModel | None

    def score(self, text: str | None, known: dict[str, float]) -> float:
        """P(toxic); ``known`` keeps what each word adds."""
        total = self.intercept
        for word in words(text):
            add = known.get(word)
            if add is None:
                add = sum(self.weights.get(t, 0.0) for t in terms_of(word))
                if len(known) < KNOWN_WORDS:
                    known[word] = add
            total += add
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, total))))


def _sample(
    texts: DataFrame, labelled: DataFrame, toxic_rows: int, clean_rows: int
) -> tuple[DataFrame, dict[int, float]]:
    """Distinct labelled texts (text, y) of each label, chosen by a hash, and how many rows each stands for.

    ``labelled`` is (id, hash, y): only ids and hashes meet the labels; the texts of the bounded sample are then read by a broadcast of it.
    """
    sizes = {int(y): n for y, n in labelled.groupBy("y").count().collect()}
    shares = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y, most in ((1, toxic_rows), (0, clean_rows))}
    share = F.when(F.col("y") == 1, int(_FINE * shares[1])).otherwise(int(_FINE * shares[0]))
    chosen = labelled.filter(F.pmod("hash", F.lit(_FINE)) < share).groupBy("hash", "y").agg(F.min("id").alias("id"))
    found = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "hash"])
    return found.dropDuplicates(["hash", "y"]).select("text", "y"), {y: 1.0 / s for y, s in shares.items()}


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
) -> ToxicityModel:
    """Learn from the documents that have a label 0 or 1; other columns are not read.

    ``toxic_rows`` and ``clean_rows`` bound the rows that are learned from. Rows are chosen by a hash of
    their text, so that copies are one row; what was left out is made up for by weights. Rows with a
    null text or id are not learned from. Without both labels every text scores the share of toxic ones.
    """
    text = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)").distinct()

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({x for w in words(t) for x in terms_of(w)}))

    hashed = text.select("id", F.xxhash64("text").alias("hash")).join(given, "id")
    with staged(hashed, "toxicity_labelled") as labelled:
        sample, stands_for = _sample(text, labelled, toxic_rows, clean_rows)
        with staged(sample.select("text", "y", terms("text").alias("terms")), "toxicity_sample") as kept:
            return _learn(kept, stands_for)


def _learn(sample: DataFrame, stands_for: dict[int, float]) -> ToxicityModel:
    """The model of a bounded sample (text, y, terms) whose rows stand for so many each, by label."""
    sizes = {y: n for y, n in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, 30.0 if toxic else -30.0, None)
    counted = (
        sample.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("in_toxic"), F.sum(1 - F.col("y")).alias("in_clean"))
        .withColumn(
            "odds",
            F.log((F.col("in_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("in_clean") + 0.5) / (clean + 1)),
        )
    )
    strong = (
        counted.filter((F.col("in_toxic") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic)) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc(F.col("odds") * F.log("in_toxic")), "term")
        .limit(TERMS)
    )
    chosen = [r.term for r in strong.select("term").collect()]
    lexicon_of = {t: i % LEXICONS for i, t in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: votes(t, lexicon_of))

    @F.pandas_udf("array<int>")
    def hits(found: pd.Series) -> pd.Series:
        return found.map(lambda terms: [numbers[t] for t in terms if t in numbers])

    numbers = {t: i for i, t in enumerate(chosen)}
    rows = sample.select("y", vote("text").alias("votes"), hits("terms").alias("hits"), F.xxhash64("text").alias("place")).collect()
    rows = sorted(rows, key=lambda r: (r.place, r.y))
    label = np.array([r.y for r in rows])
    importance = np.array([stands_for[r.y] for r in rows])
    model, chance = fit_label_model(np.array([r.votes for r in rows]), label, importance)
    features = [(np.array(r.hits, np.int64), np.ones(len(r.hits))) for r in rows]
    targets = np.column_stack([1 - chance, chance])
    fitted = train(features, targets, len(chosen), PENALTIES, importance / importance.mean())
    slope = fitted[:, 1] - fitted[:, 0]
    weights = {t: float(slope[i]) for t, i in numbers.items() if slope[i]}
    return ToxicityModel(weights, float(slope[-1]), model)


def score(text: Column, model: ToxicityModel) -> Column:
    """P(toxic) of each whole text; null and empty texts score what a text without words does."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        return pd.Series([model.score(t, known) for t in texts], dtype=float)

    return of(text.cast("string"))


def drop_rejected(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, columns unchanged."""
    rows = documents.select(F.struct("*").alias("_row"), score(F.col(text_col), model).alias("_score"))
    return rows.filter(F.col("_score") < REJECTED).select("_row.*")
