"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text takes the language whose model gives its letters the lowest cross-entropy (nats per predicted character). The
text is rejected when even that is above what held-back texts of the language show, or when it has no letter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ostiary.llm import common, kneser_ney, labelled

ORDER = 5
MAX_DOCS = 4_000
MAX_CHARS = 20_000_000
# Deviations shrink with the root of the length, up to so many characters.
STEADY = 2_000
# A text is rejected beyond so many times the largest deviation of the held-back texts, and only when its cross-entropy
# is further than this share of the way from the language's own to that of evenly spread letters: texts that mix
# languages stay.
SLACK = 1.5
LEAST_WAY = 0.65
FIELDS = "lang_pred string, score double, cross_entropy double, rejected boolean"


@dataclass
class LanguageModel:
    key: str
    languages: list[str]
    model: kneser_ney.Model
    usual: np.ndarray  # cross-entropy of held-back texts of each language
    spread: np.ndarray  # largest deviation above it, times the root of the length
    heat: float  # calibrates the probability of the chosen language


def _entropies(model: kneser_ney.Model, key: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Summed negative log probabilities per language, and predicted characters."""
    memo = common.once_per_worker(("languages", key), lambda: common.WordMemo(lambda w: kneser_ney.word_scores(model, w).astype(np.float32)))
    sums, _, _ = memo.reduce(labelled.words_of(t) for t in texts)
    return -sums[:, :-1], sums[:, -1]


def fit(examples: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from ``doc_id, text, label``: a bounded sample for each label (see ``labelled.sample``).

    Without any example the model knows no language, and every text is ``und``.
    """
    taken, languages = labelled.sample(examples, max_docs, max_chars)
    key = uuid.uuid4().hex
    if not languages:
        return LanguageModel(key, [], kneser_ney.Model(0, 0, 0.0), np.zeros(0), np.zeros(0), 1.0)
    model = labelled.fit(taken, languages, ORDER)
    shipped = examples.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"e{i} double" for i in range(len(languages)))

    def measure(batch: pa.RecordBatch) -> list:
        sums, sizes = _entropies(shipped.value, key, common.texts_of(batch, "text"))
        return [sizes, *sums.T]

    held = common.with_columns(taken.filter(F.col("part") == labelled.FOLDS - 1), f"size double, {fields}", measure)
    table = held.filter("size > 0").select(labelled.index_of(languages).alias("truth"), "size", *[f"e{i}" for i in range(len(languages))]).toArrow()
    truth, size = table.column(0).to_numpy(), table.column(1).to_numpy()
    sums = np.stack([table.column(2 + i).to_numpy() for i in range(len(languages))], 1)
    usual, spread = np.full(len(languages), model.base * -1), np.zeros(len(languages))
    for i in range(len(languages)):
        own = truth == i
        if own.any():
            usual[i] = sums[own, i].sum() / size[own].sum()
            spread[i] = max(0.0, ((sums[own, i] / size[own] - usual[i]) * np.sqrt(np.minimum(size[own], STEADY))).max())
        else:  # nothing held back: never reject
            spread[i] = np.inf
    heats = 2.0 ** np.arange(-6, 1)
    losses = [np.mean([-np.log(max(p[t], 1e-12)) for p, t in zip(_shares(sums, h), truth)]) if len(truth) else 0.0 for h in heats]
    return LanguageModel(key, languages, model, usual, spread, float(heats[int(np.argmin(losses))]))


def _shares(sums: np.ndarray, heat: float) -> np.ndarray:
    weights = np.exp(-heat * (sums - sums.min(1, keepdims=True)))
    return weights / weights.sum(1, keepdims=True)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, cross_entropy, rejected``; all texts are read whole, no shuffle.

    ``lang_pred`` is the best learned language, ``und`` (score 0, no cross-entropy, rejected) for null, empty and
    letterless texts. Ties go to the language that sorts first.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        m = shipped.value
        texts = common.texts_of(batch, text)
        if not m.languages:
            n = len(texts)
            return [pa.array(["und"] * n), np.zeros(n), pa.nulls(n, pa.float64()), np.ones(n, bool)]
        sums, sizes = _entropies(m.model, m.key, texts)
        best = sums.argmin(1)
        known = sizes > 0
        entropy = sums[np.arange(len(best)), best] / np.maximum(sizes, 1)
        limit = m.usual[best] + np.maximum(SLACK * m.spread[best] / np.sqrt(np.clip(sizes, 1, STEADY)),
                                           LEAST_WAY * np.maximum(-m.model.base - m.usual[best], 0))
        score = np.where(known, _shares(sums, m.heat)[np.arange(len(best)), best], 0.0)
        return [pa.array([m.languages[b] if k else "und" for b, k in zip(best, known)]), score,
                pa.array(entropy, mask=~known), ~known | (entropy > limit)]

    return common.with_columns(docs, FIELDS, compute)
