"""Interpolated Kneser-Ney character models of words, one column per language or class, in sorted hash arrays.

A word is read as the characters between two blanks; a character is predicted from up to ``order - 1`` characters before
it, never from beyond the blank that opens the word. All columns share the arrays, so one search serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _layout(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of `` w1 w2 ... wn ``, characters available before each position, and its word's number."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64) + 1
    ends = np.cumsum(sizes)
    reach = np.zeros(len(codes), np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    reach[1:] = np.arange(1, len(codes)) - np.repeat(ends - sizes, sizes)
    return codes + np.uint64(1), reach, owner


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][p]: hash of the k characters ending at p (meaningful where p has them)."""
    out = [np.zeros(len(codes), np.uint64)]
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            new = out[-1].copy()
            new[k - 1:] += codes[:len(codes) - k + 1] * factor
            out.append(new)
            factor = factor * MULTIPLIER
    return out


def grams(words: list[str], column: np.ndarray, counts: np.ndarray, order: int):
    """Per length k, whole-corpus pieces ``(k, open, gram, context, suffix, column, n)`` of these counted words.

    ``open`` marks grams that begin with the blank opening a word: nothing can stand before them.
    """
    codes, reach, owner = _layout(words)
    hashes = _hashes(codes, order)
    place = np.arange(1, len(codes))
    reach = reach[1:]
    for k in range(1, order + 1):
        at = place[reach >= k - 1]
        who = owner[at - 1]
        key = np.stack([hashes[k][at], column[who].astype(np.uint64)])
        by = np.lexsort(key)
        key, at = key[:, by], at[by]
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if len(at) else at
        total = np.add.reduceat(counts[who[by]], first) if len(first) else first
        at = at[first]
        yield (k, reach[at - 1] == k - 1, hashes[k][at], hashes[k - 1][at - 1], hashes[k - 1][at], key[1][first].astype(np.int32), total)


@dataclass
class Level:
    keys: np.ndarray  # sorted hashes of the grams of this length
    logs: np.ndarray  # their interpolated log probabilities, one column each
    contexts: np.ndarray  # sorted hashes of the contexts (one character shorter)
    weights: np.ndarray  # log of the mass a context leaves to shorter ones


@dataclass
class Model:
    order: int
    columns: int
    base: float
    levels: list[Level] = field(default_factory=list)

    def bytes(self) -> int:
        return sum(x.nbytes for l in self.levels for x in (l.keys, l.logs, l.contexts, l.weights))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def build(pieces, columns: int, order: int, shared: int = 0) -> Model:
    """Model from the rows of ``grams`` summed over the corpus: arrays k, open, gram, context, suffix, column, n.

    Up to length ``shared`` the counts of all columns are pooled: they back all columns off alike.
    """
    k_, open_, gram_, context_, suffix_, column_, n_ = pieces
    tables = []
    for k in range(1, order + 1):
        own = k_ == k
        keys, first, inverse = np.unique(gram_[own], return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), columns))
        np.add.at(counts, (inverse, column_[own]), n_[own])
        tables.append([keys, counts, open_[own][first], context_[own][first], suffix_[own][first]])
    for k in range(order - 1):  # below the top, count the different characters before a gram instead of the gram
        keys, counts, is_open = tables[k][:3]
        longer = tables[k + 1]
        at, there = _find(keys, longer[4])
        kinds = np.zeros_like(counts)
        np.add.at(kinds, at[there], longer[1][there] > 0)
        tables[k][1] = np.where(is_open[:, None], counts, kinds)
    alphabet = len(tables[0][0]) + 1
    model = Model(order, columns, -float(np.log(alphabet)))
    for k, table in enumerate(tables, 1):
        keys, counts, _, context, suffix = table[:5]
        if k <= shared:
            counts = np.repeat(counts.sum(1, keepdims=True), columns, 1)
        ones, twos = (counts == 1).sum(0), (counts == 2).sum(0)
        cut = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        contexts, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(contexts), columns)), np.zeros((len(contexts), columns))
        np.add.at(total, inverse, counts)
        np.add.at(kinds, inverse, counts > 0)
        left = np.where(total > 0, cut * kinds / np.maximum(total, 1e-300), 1.0)
        if k == 1:
            lower = np.full((len(keys), columns), 1.0 / alphabet)
        else:
            at, there = _find(model.levels[-1].keys, suffix)
            lower = np.where(there[:, None], np.exp(model.levels[-1].logs[at]), 1.0 / alphabet)
        own = np.where(total[inverse] > 0, np.maximum(counts - cut, 0) / np.maximum(total[inverse], 1e-300), 0.0)
        logs = np.log(own + left[inverse] * lower)
        model.levels.append(Level(keys, logs.astype(np.float32), contexts, np.log(np.maximum(left, 1e-12)).astype(np.float32)))
    return model


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Per word its log probability in every column and, last, its number of predicted characters."""
    out = np.zeros((len(words), model.columns + 1))
    if not words:
        return out
    codes, reach, owner = _layout(words)
    hashes = _hashes(codes, model.order)
    place, reach = np.arange(1, len(codes)), reach[1:]
    score = np.zeros((len(place), model.columns))
    open_ = np.arange(len(place))  # positions without a probability yet
    for k in range(model.order, 0, -1):
        level = model.levels[k - 1]
        now = open_[reach[open_] >= k - 1]
        later = open_[reach[open_] < k - 1]
        at, there = _find(level.keys, hashes[k][place[now]])
        score[now[there]] += level.logs[at[there]]
        now = now[~there]
        at, there = _find(level.contexts, hashes[k - 1][place[now] - 1])
        score[now[there]] += level.weights[at[there]]
        open_ = np.concatenate([now, later])
    score[open_] += model.base
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out[:, :-1] = np.add.reduceat(score, starts, axis=0)
    out[:, -1] = np.bincount(owner, minlength=len(words))
    return out
