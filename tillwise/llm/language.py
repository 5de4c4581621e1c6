"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams are hashed to a fixed number of features. Their document frequencies come from every document
that may be learned from; the weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of these, the same number per language, and a held-back part of the
sample sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.linear import Penalties, softmax, temperature, train

ORDERS = (1, 2, 3)
FEATURES = 1 << 14
#: Sampled rows per language, and how many of them per hundred are held back for the temperature.
SAMPLE_ROWS, CALIBRATION_SHARE = 800, 25
PENALTIES = Penalties(alpha=2.0, l1=0.02, l2=0.05, epochs=3)
UNDETERMINED = "und"
_FINE = 1 << 30


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased text and how often each occurs; ASCII non-letters count as spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    codes = np.where((codes < 0x80) & ((codes < 0x61) | (codes > 0x7A)), np.uint32(0x20), codes)
    hashed, gram = [], np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        gram = (gram[:-1] if order > 1 else gram) * np.uint32(0x01000193) + codes[order - 1 :] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(order)
            hashed.append(mixed >> np.uint32(32 - 14))
        if len(gram) < 2:
            break
    counts = np.bincount(np.concatenate(hashed), minlength=FEATURES) if hashed else np.zeros(FEATURES, np.int64)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


@dataclass(frozen=True)
class LanguageModel:
    """Names of the languages, inverse document frequencies, weights with the intercept last, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tfidf(text, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        seen, values = self.vector(text)
        chances = softmax((values @ self.weights[seen] + self.weights[-1]) / self.heat)
        best = int(np.argmax(chances))
        return self.languages[best], float(chances[best])


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, counts = ngram_counts(text)
    values = (1.0 + np.log(counts)) * idf[seen]
    size = np.sqrt((values * values).sum())
    return seen, values / size if size else values


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; summed per task, then over tasks."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[ngram_counts(text.as_py())[0]] += 1
                total[FEATURES] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=schema)

    summed = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = np.zeros(FEATURES + 1, np.int64)
    for feature, n in summed.collect():
        counts[feature] = n
    return counts[:FEATURES], int(counts[FEATURES])


def fit(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    penalties: Penalties = PENALTIES,
) -> LanguageModel:
    """Learn from the rows whose text has a letter and whose language is known; other columns are not read.

    ``sample_rows`` bounds the rows of each language that the weights are fitted on. Rows are chosen by a
    hash of their text, so that copies are one row.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("text"), F.lit(_FINE))
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    frequencies, texts = _document_frequencies(rows.select("text"))
    idf = np.log((1.0 + texts) / (1.0 + frequencies)) + 1.0

    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(_FINE * min(1.0, sample_rows / sizes[lang])))]), F.col("lang"))
    sampled = rows.filter(place < share).select("lang", place.alias("place"), "text").distinct()

    def vector(texts: pd.Series) -> pd.DataFrame:
        pairs = [tfidf(t, idf) for t in texts]
        return pd.DataFrame(
            {"seen": [s.astype("<u2").tobytes() for s, _ in pairs], "vals": [v.astype("<f4").tobytes() for _, v in pairs]}
        )

    as_vector = F.pandas_udf(vector, "seen binary, vals binary")
    found = sampled.select("lang", "place", as_vector("text").alias("v")).select("lang", "place", "v.*").collect()
    found = sorted(found, key=lambda r: (r.place, r.lang))
    xs = [(np.frombuffer(r.seen, "<u2").astype(np.int64), np.frombuffer(r.vals, "<f4").astype(np.float64)) for r in found]
    truth = np.array([languages.index(r.lang) for r in found])
    back = np.array([r.place // 7 % 100 < CALIBRATION_SHARE for r in found], bool)
    fitted = np.flatnonzero(~back)
    weights = train([xs[i] for i in fitted], np.eye(len(languages))[truth[fitted]], FEATURES, penalties)
    held = np.flatnonzero(back)
    scores = np.array([v @ weights[s] + weights[-1] for s, v in (xs[i] for i in held)]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature(scores, truth[held]))


def predict(text: Column, model: LanguageModel) -> Column:
    """(lang_pred, score): ``und`` with score 0 for a null text, one without letters, or an empty model."""
    holder = model

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([holder.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(text.cast("string"))
