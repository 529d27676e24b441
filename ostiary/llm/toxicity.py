"""Toxicity from class-conditional Kneser-Ney models of toxic and ordinary text.

Both classes share the counts of short grams, so a rare expression backs off alike in both and only what differs
between the classes tells. Log-likelihoods are compared per character of the text and, as a few words can make a
long text toxic, per word of its most telling word; a logistic curve fitted on held-back texts turns both into a score.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common, kneser_ney, labelled

ORDER = 5
SHARED = 1
MAX_DOCS = 20_000
MAX_CHARS = 60_000_000
THRESHOLD = 0.7
FIELDS = "score double, predicted int"


@dataclass
class ToxicityModel:
    key: str
    model: kneser_ney.Model | None
    weights: np.ndarray  # of the constant, the text's and the strongest word's log-likelihood ratio


def _features(model: kneser_ney.Model, key: str, texts: list[str]) -> np.ndarray:
    def ratios(words: list[str]) -> np.ndarray:
        scores = kneser_ney.word_scores(model, words)
        return np.stack([scores[:, 1] - scores[:, 0], scores[:, 2]], 1).astype(np.float32)

    memo = common.once_per_worker(("toxicity", key), lambda: common.WordMemo(ratios))
    sums, largest, _ = memo.reduce((labelled.words_of(t) for t in texts), maxima=True)
    return np.stack([np.ones(len(sums)), sums[:, 0] / np.maximum(sums[:, 1], 1), np.maximum(largest[:, 0], 0) / 10], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton steps; the ridge keeps them finite when the classes separate."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(examples: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learn from ``doc_id, text, label`` (1 toxic, 0 ordinary): a bounded sample for each class.

    With one class only, or none, every text gets that class's score (1, 0; 0 without examples).
    """
    taken, classes = labelled.sample(examples.filter("label IN (0, 1)"), max_docs, max_chars)
    key = uuid.uuid4().hex
    if len(classes) < 2:
        return ToxicityModel(key, None, np.array([30.0 if classes == [1] else -30.0, 0, 0]))
    model = labelled.fit(taken, [0, 1], ORDER, SHARED)
    shipped = examples.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> list:
        return list(_features(shipped.value, key, common.texts_of(batch, "text")).T)

    held = common.with_columns(taken.filter(F.col("part") == labelled.FOLDS - 1), "one double, whole double, word double", measure)
    table = held.select("one", "whole", "word", F.col("label").cast("double")).toArrow()
    x = np.stack([table.column(i).to_numpy() for i in range(3)], 1)
    return ToxicityModel(key, model, _logistic(x, table.column(3).to_numpy()))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up). Null and empty texts score as texts
    without a word. Whole texts, one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        m = shipped.value
        texts = common.texts_of(batch, text)
        x = _features(m.model, m.key, texts) if m.model else np.repeat([[1.0, 0.0, 0.0]], len(texts), 0)
        p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
        return [p, (p >= threshold).astype(np.int32)]

    return common.with_columns(docs, FIELDS, compute)
