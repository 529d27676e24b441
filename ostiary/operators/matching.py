"""One-to-one matching inside a tolerance: most pairs first, then the least total distance."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.operators import spatial
from ostiary.operators.graph import connected_components
from ostiary.operators.spatial import pairs_within

# Candidate pairs one task may solve as a single assignment problem: of a whole case, and of a component of a larger one
# (about ten seconds and 30 MB at the limit).
CASE_PAIRS = 10_000
COMPONENT_PAIRS = 150_000
# Smaller differences of path costs do not count, in the solver and in the joins alike.
TOLERANCE = 1e-9


def assign(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of the chosen pairs: maximum cardinality, then minimum total cost.

    Left ids are put in one after the other by a cheapest alternating path, found with potentials that keep every pair's
    remaining cost at zero or more, so a search looks at a few pairs around its start. Leaving an id out costs more than
    all pairs together. Pairs come ordered by (left, right), and of equally cheap ones the first is taken.
    """
    left_ids, a = np.unique(left, return_inverse=True)
    right_ids, b = np.unique(right, return_inverse=True)
    if not len(left_ids):
        return np.zeros(0, int)
    cost = np.asarray(cost, float)
    order = np.argsort(a, kind="stable")
    begin = np.searchsorted(a[order], np.arange(len(left_ids) + 1)).tolist()
    pair, to, price = order.tolist(), b[order].tolist(), cost[order].tolist()
    out = (min(len(left_ids), len(right_ids)) + 1) * (float(cost.max()) + 1.0)  # what leaving a left id out costs
    u = np.minimum.reduceat(cost[order], begin[:-1]).tolist()
    v = [0.0] * len(right_ids)
    owner = [-1] * len(right_ids)   # left id that holds a right id
    holder = [-1] * len(left_ids)   # position of the pair that a left id holds
    waiting = []
    for i in range(len(left_ids)):
        for e in range(begin[i], begin[i + 1]):
            if price[e] == u[i] and owner[to[e]] < 0:
                owner[to[e]], holder[i] = i, e
                break
        else:
            waiting.append(i)
    for start in waiting:
        reached = {}                # right id: least remaining cost of a path to it
        via = {}                    # right id: position of the path's last pair
        done: list[int] = []        # right ids whose path is final, in that order
        walked = [(start, 0.0)]     # left ids on final paths
        heap: list[tuple[float, int]] = []
        ends, end = out - u[start], start   # cheapest way to end so far: leave `end` out
        at, so_far, free = start, 0.0, -1
        while True:
            base = so_far - u[at]
            for e in range(begin[at], begin[at + 1]):
                r = to[e]
                offer = base + price[e] - v[r]
                if offer < ends and offer < reached.get(r, ends) - TOLERANCE:
                    reached[r], via[r] = offer, e
                    heappush(heap, (offer, r))
            while heap and heap[0][0] > reached[heap[0][1]]:
                heappop(heap)
            if not heap or heap[0][0] >= ends:
                break
            so_far, r = heappop(heap)
            reached[r] = so_far
            if owner[r] < 0:
                ends, free = so_far, r
                break
            done.append(r)
            at = owner[r]
            walked.append((at, so_far))
            if so_far + out - u[at] < ends:
                ends, end = so_far + out - u[at], at
        for r in done:
            v[r] -= ends - reached[r]
        for i, gone in walked:
            u[i] += ends - gone
        if free < 0:
            if end == start:
                continue
            free, holder[end] = to[holder[end]], -1
        while True:
            e = via[free]
            i = _left_of(begin, e)
            owner[free], (free, holder[i]) = i, (to[holder[i]] if holder[i] >= 0 else -1, e)
            if i == start:
                break
    return np.sort(np.array([pair[e] for e in holder if e >= 0], int))


def _left_of(begin: list[int], position: int) -> int:
    return bisect_right(begin, position) - 1


@F.pandas_udf(ArrayType(IntegerType()))
def _assign_lists(left: pd.Series, right: pd.Series, cost: pd.Series) -> pd.Series:
    # Pairs that share no end are all chosen.
    return pd.Series([
        np.arange(len(a), dtype="int32") if len(set(a)) == len(set(b)) == len(a) else assign(a, b, c).astype("int32")
        for a, b, c in zip(left, right, cost)])


def _solve(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Choose pairs per group of ``by``; groups hold a bounded number of pairs."""
    grouped = pairs.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_left", "_right", "distance"))).alias("_pairs")
    )
    single = grouped.filter(F.size("_pairs") == 1).select(*by, "_pairs")
    several = grouped.filter(F.size("_pairs") > 1).withColumn(
        "_chosen", _assign_lists("_pairs._left", "_pairs._right", "_pairs.distance")
    ).select(*by, F.transform("_chosen", lambda i: F.get("_pairs", i)).alias("_pairs"))
    return single.unionByName(several).select(*by, F.inline("_pairs"))


def _choose(pairs: DataFrame, by: list[str], case_pairs: int, component_pairs: int) -> DataFrame:
    """Cases with few pairs are solved whole. A larger case is split into the connected components of its
    pair graph, which are independent problems; a component still too large for one task is augmented by
    Spark joins (:func:`_augment`)."""
    small, large = scale.split_by_size(pairs, by, case_pairs)
    chosen = _solve(small, by)
    if large is None:
        return chosen
    large = scale.checkpoint(large)
    edges = large.select(*by, F.concat(F.lit("l"), F.col("_left")).alias("a"), F.concat(F.lit("r"), F.col("_right")).alias("b"))
    components = connected_components(edges, by).filter(F.col("node").startswith("l")).select(
        *by, F.substring("node", 2, 30).cast("bigint").alias("_left"), F.col("component").alias("_component"))
    labelled = large.join(components, [*by, "_left"])
    keys = [*by, "_component"]
    small, large = scale.split_by_size(labelled, keys, component_pairs)
    chosen = chosen.unionByName(_solve(small, keys).select(*by, "_left", "_right", "distance"))
    if large is not None:
        chosen = chosen.unionByName(_augment(large, keys).select(*by, "_left", "_right", "distance"))
    return chosen


def _augment(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same successive cheapest paths for components no task can hold, as joins over the pair table.

    All components advance together, one path each per round. A path search relaxes costs until nothing
    changes; every step is two joins and two partial aggregates, and each round is checkpointed.
    """
    edges = scale.checkpoint(pairs.select(*keys, "_left", "_right", "distance"))
    held = scale.checkpoint(edges.limit(0))
    while True:
        tagged = edges.join(held.withColumn("_held", F.lit(True)), [*keys, "_left", "_right", "distance"], "left")
        free_edges = scale.checkpoint(tagged.filter(F.col("_held").isNull()).drop("_held"))
        lefts = edges.select(*keys, "_left").distinct()
        reach = lefts.join(held, [*keys, "_left"], "left_anti").select(
            *keys, "_left", F.lit(0.0).alias("_cost"))
        reach = scale.checkpoint(reach)
        while True:
            offered = reach.join(free_edges, [*keys, "_left"]).groupBy(*keys, "_right").agg(
                F.min(F.struct((F.col("_cost") + F.col("distance")).alias("_cost"), F.col("_left"))).alias("_best"))
            back = offered.join(held, [*keys, "_right"]).select(
                *keys, "_left", (F.col("_best._cost") - F.col("distance")).alias("_cost"))
            merged = scale.checkpoint(reach.unionByName(back).groupBy(*keys, "_left").agg(
                F.min("_cost").alias("_cost")))
            before = reach.select(*keys, "_left", F.col("_cost").alias("_old"))
            moved = merged.join(before, [*keys, "_left"], "left").filter(
                F.col("_old").isNull() | (F.col("_cost") < F.col("_old") - TOLERANCE))
            if moved.isEmpty():
                break
            reach = merged
        offered = scale.checkpoint(reach.join(free_edges, [*keys, "_left"]).groupBy(*keys, "_right").agg(
            F.min(F.struct((F.col("_cost") + F.col("distance")).alias("_cost"), F.col("_left"))).alias("_best"))
            .select(*keys, "_right", "_best.*"))
        ends = offered.join(held, [*keys, "_right"], "left_anti").groupBy(*keys).agg(
            F.min(F.struct("_cost", "_right", "_left")).alias("_end")).select(*keys, "_end._right", "_end._left")
        front = scale.checkpoint(ends)
        if front.isEmpty():
            return held
        added, removed = front, None
        while not front.isEmpty():
            # The left id at the front gives up its old right id, which was reached from another left id.
            given = front.select(*keys, "_left").join(held, [*keys, "_left"]).select(*keys, "_left", "_right")
            removed = given if removed is None else removed.unionByName(given)
            front = scale.checkpoint(given.select(*keys, "_right").join(
                offered.select(*keys, "_right", "_left"), [*keys, "_right"]))
            added = added.unionByName(front.select(*added.columns))
        kept = held.join(removed.select(*keys, "_left", "_right"), [*keys, "_left", "_right"], "left_anti")
        gained = edges.join(added.select(*keys, "_left", "_right"), [*keys, "_left", "_right"])
        held = scale.checkpoint(kept.select(*edges.columns).unionByName(gained.select(*edges.columns)))


def match_one_to_one(
    predictions: DataFrame, references: DataFrame, tolerances: list[float], by: list[str] | None = None,
    case_pairs: int = CASE_PAIRS, component_pairs: int = COMPONENT_PAIRS,
) -> DataFrame:
    """Matches per tolerance with ostium, seed, radius and direction errors.

    Both sides carry ``by``, ``ord`` (bigint, unique per case), ``instance_id``, ``ostium``, ``seed``,
    ``direction`` and ``radius_mm``. Cases with up to CASE_ROWS rows on either side are matched inside one row a case; in the
    others the distance join runs once at the largest tolerance, and each pair is repeated for the tolerances it satisfies.
    """
    by = by or ["case_id"]
    check_tolerances(tolerances)
    tolerances = sorted({float(t) for t in tolerances})
    rows = min(spatial.CASE_ROWS, math.isqrt(case_pairs))  # such a case has at most case_pairs pairs
    fields = [*by, "ord", "instance_id", "ostium", "seed", "direction", "radius_mm"]
    (few, few_references), (many, many_references) = scale.small_cases(predictions.select(*fields), references.select(*fields), by, rows)
    found = []
    if few is not None:
        found.append(_match_inside(few, few_references, tolerances, by))
    if many is not None:
        found.append(_match_pairs(many, many_references, tolerances, by, case_pairs, component_pairs))
    return reduce(DataFrame.unionByName, found)


def _match_inside(predictions: DataFrame, references: DataFrame, tolerances: list[float], by: list[str]) -> DataFrame:
    """Both sides of a case travel as one array each, so rows that already lie by case are not shuffled."""
    fields = ["ord", "instance_id", "ostium", "seed", "direction", "radius_mm"]
    sides = [rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
             for rows, name in ((predictions, "_p"), (references, "_r"))]

    def pairs(p: Column, i: Column) -> Column:
        gaps = F.transform("_r", lambda r, j: F.struct(
            i.alias("left"), j.alias("right"), g.distance(g.xyz(p["ostium"]), g.xyz(r["ostium"])).alias("distance")))
        return F.filter(gaps, lambda pair: pair["distance"] <= tolerances[-1])

    near = scale.computed_once(sides[0].join(sides[1], by), "_all", F.flatten(F.transform("_p", pairs))).filter(F.size("_all") > 0)
    each = near.select("*", F.explode(F.array(*[F.lit(t) for t in tolerances])).alias("tolerance_mm"))
    each = scale.computed_once(each, "_near", F.filter("_all", lambda pair: pair["distance"] <= F.col("tolerance_mm"))).filter(F.size("_near") > 0)
    chosen = each.withColumn("_chosen", _assign_lists("_near.left", "_near.right", "_near.distance")).select(
        *by, "tolerance_mm", "_p", "_r", F.inline(F.transform("_chosen", lambda i: F.get("_near", i))))
    ends = chosen.select(*by, "tolerance_mm", "distance", F.get("_p", F.col("left")).alias("p"), F.get("_r", F.col("right")).alias("r"))
    return _with_errors(ends, by, lambda side, name: F.col(f"{side}.{name}"))


def _match_pairs(
    predictions: DataFrame, references: DataFrame, tolerances: list[float], by: list[str], case_pairs: int, component_pairs: int,
) -> DataFrame:
    pairs = scale.checkpoint(candidate_pairs(predictions, references, max(tolerances), by))
    listed = F.filter(F.array(*[F.lit(t) for t in tolerances]), lambda t: F.col("distance") <= t)
    expanded = pairs.select(*by, F.explode(listed).alias("tolerance_mm"), "_left", "_right", "distance")
    chosen = _choose(expanded, [*by, "tolerance_mm"], case_pairs, component_pairs)
    left = [F.col(name).alias(f"p_{name}") for name in ("instance_id", "seed", "direction", "radius_mm")]
    right = [F.col(name).alias(f"r_{name}") for name in ("instance_id", "seed", "direction", "radius_mm")]
    full = chosen.join(predictions.select(*by, F.col("ord").alias("_left"), *left), [*by, "_left"]).join(
        references.select(*by, F.col("ord").alias("_right"), *right), [*by, "_right"])
    return _with_errors(full, by, lambda side, name: F.col(f"{side}_{name}"))


def _with_errors(matched: DataFrame, by: list[str], of: Callable[[str, str], Column]) -> DataFrame:
    return matched.select(
        *by, "tolerance_mm", of("p", "instance_id").alias("prediction_id"), of("r", "instance_id").alias("reference_id"),
        F.col("distance").alias("ostium_error_mm"),
        g.distance(g.xyz(of("p", "seed")), g.xyz(of("r", "seed"))).alias("seed_error_mm"),
        F.abs(of("p", "radius_mm") - of("r", "radius_mm")).alias("radius_error_mm"),
        g.angle_degrees(g.xyz(of("p", "direction")), g.xyz(of("r", "direction"))).alias("direction_error_degrees"),
    )


def check_tolerances(tolerances: list[float]) -> None:
    for tolerance in tolerances:
        if not 0 < tolerance < float("inf"):
            raise ValueError("a matching tolerance is a positive, finite distance")


def candidate_pairs(predictions: DataFrame, references: DataFrame, tolerance: float, by: list[str]) -> DataFrame:
    return pairs_within(
        predictions.select(*by, F.col("ord").alias("_left"), F.col("ostium").alias("_p")),
        references.select(*by, F.col("ord").alias("_right"), F.col("ostium").alias("_r")),
        by, "_p", "_r", tolerance,
    ).drop("_p", "_r")


def unmatched(rows: DataFrame, matches: DataFrame, match_id: str) -> DataFrame:
    """Rows of one side that no match of one tolerance names."""
    named = matches.select("case_id", F.col(match_id).alias("instance_id"))
    return rows.select("case_id", "instance_id").join(named, ["case_id", "instance_id"], "left_anti")


def missing_predictions(reference_cases: DataFrame, predicted_cases: DataFrame) -> DataFrame:
    """Reference cases without any prediction record."""
    return reference_cases.select("case_id").distinct().join(predicted_cases.select("case_id"), "case_id", "left_anti")
