"""One-to-one assignment against brute force, a plain augmenting search, and at size."""

import itertools
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from ostiary.operators import matching


def _best(left, right, cost):
    """Most pairs, then least cost, over all sets of pairs."""
    pairs = list(zip(left, right, cost))
    best = (0, 0.0)
    for size in range(1, min(len(set(left)), len(set(right))) + 1):
        for chosen in itertools.combinations(pairs, size):
            if len({p[0] for p in chosen}) == size == len({p[1] for p in chosen}):
                best = min(best, (-size, sum(p[2] for p in chosen)))
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.sampled_from([0.0, 0.5, 1.0, 1.25, 2.0])), max_size=9, unique_by=lambda p: p[:2]))
def test_assignment_is_the_best_of_all(pairs):
    pairs.sort()
    left, right, cost = (np.array([p[i] for p in pairs]) for i in range(3))
    chosen = matching.assign(left, right, cost)
    assert len(set(left[chosen])) == len(chosen) == len(set(right[chosen]))
    assert (-len(chosen), round(float(cost[chosen].sum()), 9)) == tuple(round(x, 9) for x in _best(left.tolist(), right.tolist(), cost.tolist()))


def test_equal_pairs_take_the_first():
    assert matching.assign(np.array([1, 1, 2, 2]), np.array([5, 6, 5, 6]), np.ones(4)).tolist() == [0, 3]
    assert matching.assign(np.array([4, 9]), np.array([7, 7]), np.ones(2)).tolist() == [0]


def _component(pairs, ids, seed):
    rng = np.random.default_rng(seed)
    p, r = rng.random((ids, 3)) * 12, rng.random((ids, 3)) * 12
    gap = np.sqrt(((p[:, None] - r[None]) ** 2).sum(2))
    left, right = np.nonzero(gap <= np.partition(gap.ravel(), pairs)[pairs])
    return left, right, gap[left, right]


def test_large_components_in_seconds():
    for pairs, ids, limit in ((20_000, 2_500, 5), (50_000, 4_000, 30)):
        problem = _component(pairs, ids, 2)
        start = time.time()
        chosen = matching.assign(*problem)
        assert time.time() - start < limit and len(chosen) > 0.9 * ids
        # no pair that would improve: every unused pair has an end that is held
        held = set(problem[0][chosen]), set(problem[1][chosen])
        assert all(a in held[0] or b in held[1] for a, b in zip(*problem[:2]))


def test_many_for_one_spot():
    left, right = np.repeat(np.arange(4_000), 12), np.tile(np.arange(12), 4_000)
    cost = np.random.default_rng(3).random(48_000)
    chosen = matching.assign(left, right, cost)
    assert len(chosen) == 12 and cost[chosen].sum() < 0.05
