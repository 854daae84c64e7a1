"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams (operator 4).

Features are letter pairs and triples of the lower-cased text with every run of other
characters as one blank, hashed to ``DIMENSIONS`` columns; the term frequency is the share of the
text's n-grams, the inverse document frequency comes from all training rows. Weights are fitted by
follow-the-regularised-leader with elastic-net penalties, which leaves most of them at zero; a
temperature fitted on rows that trained nothing calibrates the probabilities.

The fit uses at most ``sample`` rows (equal shares of each language, smallest hashes of the id),
or ``LEAST`` rows of each language if that is more; every language is learned. It takes 1 MB of the
driver for each language; what is sent to the workers are the weights that are not zero.
The document frequencies and every prediction cover all rows and whole texts.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegate.llm.common import arrow_rows, small_batches

DIMENSIONS = 1 << 16
UNKNOWN = "und"
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType(), False),
                           T.StructField("score", T.DoubleType(), False)])
#: Rows of each language that the fit may use, however many languages there are.
LEAST = 12


def ngrams(text: str | None) -> np.ndarray:
    """Columns of all letter pairs and triples of ``text``; none without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letters = _is_letter(points)
    if not letters.any():
        return np.zeros(0, np.int64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[0] = True
    codes = np.where(letters, points, 32)[keep].astype(np.uint32)
    pairs = (codes[:-1] * np.uint32(0x9E3779B1)) ^ (codes[1:] * np.uint32(0x85EBCA77))
    triples = (pairs[:-1] * np.uint32(0xC2B2AE3D)) ^ (codes[2:] * np.uint32(0x27D4EB2F))
    found = np.concatenate([pairs, triples])
    found ^= found >> np.uint32(15)
    found *= np.uint32(0x2C1B3C6D)
    return (found >> np.uint32(16)).astype(np.int64)


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    known = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    high = np.flatnonzero(points >= len(_LETTERS))
    if len(high):
        known[high] = [chr(c).isalpha() for c in points[high]]
    return known


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


@dataclass
class LanguageModel:
    """Weights that are not zero: those of column c stand at bounds[c]:bounds[c + 1]."""
    languages: list[str]
    bounds: np.ndarray
    classes: np.ndarray
    weights: np.ndarray  # times the inverse frequency of the column
    bias: np.ndarray
    temperature: float

    @classmethod
    def of(cls, languages: list[str], dense: np.ndarray, bias: np.ndarray,
           temperature: float) -> LanguageModel:
        columns, classes = np.nonzero(dense)
        return cls(languages, np.searchsorted(columns, np.arange(len(dense) + 1)),
                   classes.astype(np.int32), dense[columns, classes].astype(np.float32), bias,
                   temperature)

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of one text from its n-gram columns."""
        starts = self.bounds[found]
        sizes = self.bounds[found + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        sums = np.bincount(self.classes[at], self.weights[at], minlength=len(self.languages))
        score = (sums / len(found) + self.bias) / self.temperature
        score = np.exp(score - score.max())
        return score / score.sum()


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of rows with each n-gram, and of rows; one vector per batch is summed."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        total, seen = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, bool)
        for text in batch.column("text"):
            seen[ngrams(text.as_py())] = True
            own = np.flatnonzero(seen)
            total[own] += 1
            seen[own] = False
        own = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(own, DIMENSIONS)), pa.array(np.append(total[own], batch.num_rows))],
            names=["gram", "docs"])

    sums = arrow_rows(docs.select("text"), make, "gram long, docs long", "text").groupBy(
        "gram").agg(F.sum("docs").alias("docs")).toPandas()
    counts = np.zeros(DIMENSIONS + 1, np.int64)
    counts[sums["gram"]] = sums["docs"]
    return counts[:-1], int(counts[-1])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-3,
             ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (columns, values, class) rows by per-coordinate FTRL-proximal."""
    z = np.zeros((DIMENSIONS + 1, classes))
    n = np.zeros((DIMENSIONS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        raw, size = z[at], np.sqrt(n[at])
        penalty = np.where(at[:, None] == DIMENSIONS, 0.0, l1)
        out = -(raw - np.sign(raw) * penalty) / ((beta + size) / alpha + l2)
        return np.where(np.abs(raw) <= penalty, 0.0, out)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for row in order.permutation(len(rows)):
            columns, values, label = rows[row]
            at, x = np.append(columns, DIMENSIONS), np.append(values, 1.0)
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            gradient = x[:, None] * p
            before = n[at]
            after = before + gradient ** 2
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    every = weights(np.arange(DIMENSIONS + 1))
    return every[:-1], every[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample: int = 4000) -> LanguageModel | None:
    """Fit on rows with a language and a letter that are not held out; None without any."""
    labelled = docs.filter(F.col("lang").isNotNull() & (bucket(F.col("doc_id")) != 0)).select(
        "doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("held"))
    languages = sorted(row["lang"] for row in counts.collect())
    if not languages:
        return None
    most = max(sample, LEAST * len(languages))
    # hash below share / count: about ``share`` rows of each language, sure to be few
    draw = F.pmod(F.xxhash64("doc_id", "lang", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a row per language
    drawn = labelled.join(F.broadcast(counts), "lang").withColumn(
        "draw", draw * F.col("held") / F.lit(most / len(languages))).filter("draw < 1.2").select(
        "doc_id", "text", "lang", "draw", bucket(F.col("doc_id")).alias("bucket"))
    frequency, rows = document_counts(labelled)
    inverse = np.log((1 + rows) / (1 + frequency)) + 1

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, values = [], []
        for text in batch.column("text"):
            own, times = np.unique(ngrams(text.as_py()), return_counts=True)
            columns.append(own.astype(np.int32).tobytes())
            values.append((times / max(times.sum(), 1)).astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("bucket"), batch.column("draw"),
             pa.array(columns, pa.binary()), pa.array(values, pa.binary())],
            names=["lang", "bucket", "draw", "columns", "values"])

    # ids and n-grams of the sample only; a text gives DIMENSIONS columns at most
    table = arrow_rows(drawn, make, "lang string, bucket long, draw double, columns binary, "
                       "values binary", "text").orderBy("draw", "lang", "columns").limit(most)
    picked = [row for row in table.collect() if row["columns"]]
    if not picked:
        return None
    number = {name: k for k, name in enumerate(languages)}
    scale = float(np.sqrt(DIMENSIONS))
    vectors = [(own := np.frombuffer(row["columns"], np.int32),
                np.frombuffer(row["values"], np.float32) * inverse[own] * scale / 16,
                number[row["lang"]]) for row in picked]
    # rows of bucket 1 calibrate, unless a language has no others to learn from
    learned = {row["lang"] for row in picked if row["bucket"] != 1}
    tuning = [row["bucket"] == 1 and row["lang"] in learned for row in picked]
    fitted = [v for v, held in zip(vectors, tuning) if not held] or vectors
    held = [v for v, h in zip(vectors, tuning) if h] or vectors
    weights, bias = fit_ftrl(fitted, len(languages))
    scores = np.array([values @ weights[own] + bias for own, values, _ in held])
    temperature = fit_temperature(scores, np.array([label for *_, label in held]))
    weights = (weights * (inverse * scale / 16)[:, None]).astype(np.float32)
    return LanguageModel.of(languages, weights, bias, temperature)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of ``docs`` and a struct ``language``: lang_pred, score.

    Only the text decides. ``lang_pred`` is ``und`` with score 0 for null texts, texts without a
    letter and without a model. A column named ``language`` is replaced.
    """
    small_batches(docs)
    # DIMENSIONS rows of weights that are not zero
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def language(texts: pd.Series) -> pd.DataFrame:
        found_model, out = shared.value, []
        for text in texts:
            found = ngrams(text)
            if found_model is None or not len(found):
                out.append((UNKNOWN, 0.0))
                continue
            p = found_model.probabilities(found)
            best = int(p.argmax())
            out.append((found_model.languages[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("language", language("text"))


def identify(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """Train on ``docs`` and predict every row of it; see ``train`` and ``predict``.

    Needs doc_id, text and lang. No rows give no rows; ties of probability go to the first language
    by name; repeated rows get equal predictions.
    """
    return predict(docs, train(docs, sample))
