"""Every operator with a second way for large groups gives the same rows on both ways, and matches brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary.operators import graph, matching, metrics, ordering, polyline, rings, suppress as sp, training
from ostiary.operators.spatial import keep_within, nearest_within, pairs_within

POINT = "struct<x:double,y:double,z:double>"


def points(spark, rng, n, cases=3, hot=0.6, span=12.0):
    """Case 0 holds most rows."""
    rows = []
    for i in range(n):
        case = 0 if rng.random() < hot else int(rng.integers(1, cases))
        rows.append((case, i, tuple(float(v) for v in rng.random(3) * span)))
    return rows, spark.createDataFrame(rows, f"case_id int, ord bigint, p {POINT}")


def gap(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def greedy(rows, radius):
    kept, out = {}, {}
    for case, rank, p in sorted(rows):
        hit = next((k for k in kept.get(case, []) if gap(k[1], p) < radius), None)
        if hit is None:
            kept.setdefault(case, []).append((rank, p))
            out[rank] = ("retained", None, len(kept[case]))
        else:
            out[rank] = ("merged", hit[0], None)
    return out


@pytest.mark.parametrize("fold,tail", [(1000, 1000), (5, 1000), (5, 3)])
def test_suppression_routes_equal_sequential_greedy(spark, fold, tail):
    rng = np.random.default_rng(3)
    rows, frame = points(spark, rng, 400)
    got = sp.suppress(frame, ["case_id"], "ord", "p", 2.5, fold_rows=fold, tail_rows=tail).collect()
    want = greedy(rows, 2.5)
    assert len(got) == len(rows)
    for r in got:
        assert (r["decision"], r["suppressor_rank"], r["output_no"]) == want[r["ord"]]


def test_suppression_of_many_copies_at_one_place(spark):
    rows = [(0, i, (1.0, 1.0, 1.0)) for i in range(300)] + [(0, 300 + i, (float(i * 5), 0.0, 0.0)) for i in range(1, 5)]
    frame = spark.createDataFrame(rows, f"case_id int, ord bigint, p {POINT}")
    got = sp.suppress(frame, ["case_id"], "ord", "p", 3.0, fold_rows=2, tail_rows=2)
    assert got.filter("decision = 'retained'").count() == 5
    assert got.filter("suppressor_rank = 0").count() == 299


def test_suppression_decision_log(spark):
    rows = [(0, 1, (0.0, 0.0, 0.0), 8.0), (0, 2, (1.0, 0.0, 0.0), 1.0), (0, 3, (2.0, 0.0, 0.0), 9.0), (0, 4, (3.0, 0.0, 0.0), 8.0)]
    frame = spark.createDataFrame(rows, f"case_id int, ord bigint, p {POINT}, r double")
    alive = 1 / (1 + F.exp(-(F.col("r") - 4))) >= 0.5
    got = {r["ord"]: r for r in sp.suppress(frame, ["case_id"], "ord", "p", 3.0, alive).collect()}
    assert [got[i]["decision"] for i in range(1, 5)] == ["retained", "below_threshold", "merged", "retained"]
    assert got[3]["suppressor_no"] == 1 and got[4]["output_no"] == 2


def brute_assignment(pairs):
    lefts = sorted({a for a, _, _ in pairs})
    best = (0, 0.0)
    options = {a: [(b, d) for x, b, d in pairs if x == a] for a in lefts}

    def walk(i, used, n, cost):
        nonlocal best
        if i == len(lefts):
            if (n, -cost) > (best[0], -best[1]):
                best = (n, cost)
            return
        walk(i + 1, used, n, cost)
        for b, d in options[lefts[i]]:
            if b not in used:
                walk(i + 1, used | {b}, n + 1, cost + d)

    walk(0, frozenset(), 0, 0.0)
    return best


def test_assignment_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        pairs = [(i, j, float(rng.random() * 4)) for i in range(n) for j in range(m) if rng.random() < 0.6]
        if not pairs:
            continue
        left, right, cost = (np.array(v) for v in zip(*pairs))
        chosen = matching.assign(left, right, cost)
        assert len(set(left[chosen])) == len(set(right[chosen])) == len(chosen)
        size, total = brute_assignment(pairs)
        assert len(chosen) == size and abs(cost[chosen].sum() - total) < 1e-9


@pytest.mark.parametrize("case_pairs,component_pairs", [(2000, 2000), (2, 2000), (2, 2)])
def test_matching_routes(spark, case_pairs, component_pairs):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for case in range(3):
        pairs = [(i, j, float(rng.random() * 3)) for i in range(5) for j in range(5) if rng.random() < 0.45]
        want[case] = brute_assignment(pairs)
        rows += [(case, i, j, d) for i, j, d in pairs]
    frame = spark.createDataFrame(rows, "case_id int, _left bigint, _right bigint, distance double")
    got = matching._choose(frame, ["case_id"], case_pairs, component_pairs).collect()
    for case, (size, total) in want.items():
        mine = [r for r in got if r["case_id"] == case]
        assert len(mine) == size == len({r["_left"] for r in mine}) == len({r["_right"] for r in mine})
        assert abs(sum(r["distance"] for r in mine) - total) < 1e-9


@pytest.mark.parametrize("limit", [10_000, 7])
def test_running_totals_and_percentiles(spark, limit):
    rng = np.random.default_rng(2)
    rows = [(0 if i % 3 else 1, i, float(rng.integers(0, 20)) / 4) for i in range(120)]
    frame = spark.createDataFrame(rows, "case_id int, i int, v double")
    ranked = ordering.running_totals(frame, ["case_id"], [F.col("v").desc(), F.col("i")], {"n": F.lit(1), "s": F.col("v")}, limit)
    for case in (0, 1):
        mine = sorted((r for r in ranked.collect() if r["case_id"] == case), key=lambda r: r["n"])
        expected = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[2], r[1]))
        assert [(r["i"], r["n"]) for r in mine] == [(e[1], k + 1) for k, e in enumerate(expected)]
        assert np.allclose([r["s"] for r in mine], np.cumsum([e[2] for e in expected]))
    for by in (["case_id"], []):
        got = ordering.exact_percentiles(frame, by, "v", {"a": 0.5, "b": 0.95, "c": 0.01}, limit).collect()
        for r in got:
            values = [v for c, _, v in rows if not by or c == r["case_id"]]
            assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(values, [50, 95, 1]))


def test_error_stats_of_large_and_empty_groups(spark):
    rows = [(float(i), float(i * 2), None if i % 2 else float(i), 1.0) for i in range(40)]
    frame = spark.createDataFrame(rows, ", ".join(f"{e} double" for e in metrics.ERRORS))
    for limit in (1000, 5):
        r = metrics.error_stats(frame, limit=limit).first()
        assert r["ostium_error_mm_median"] == 19.5 and abs(r["radius_error_mm_p95"] - np.percentile(range(0, 40, 2), 95)) < 1e-9
    empty = metrics.error_stats(frame.limit(0)).first()
    assert empty["matches"] == 0 and empty["ostium_error_mm_mean"] is None and empty["seed_error_mm_p95"] is None


def test_pairs_within_is_complete_and_unique(spark):
    rng = np.random.default_rng(8)
    a_rows, a = points(spark, rng, 150)
    b_rows, b = points(spark, rng, 150)
    b = b.select("case_id", F.col("ord").alias("o2"), F.col("p").alias("q"))
    got = [(r["ord"], r["o2"]) for r in pairs_within(a, b, ["case_id"], "p", "q", 2.0).collect()]
    want = {(i, j) for c, i, p in a_rows for d, j, q in b_rows if c == d and gap(p, q) <= 2.0}
    assert len(got) == len(want) and set(got) == want
    near = {r["ord"] for r in keep_within(a, b, ["case_id"], "p", "q", 2.0).collect()}
    assert near == {i for i, _ in want}
    far = {r["ord"] for r in keep_within(a, b, ["case_id"], "p", "q", 2.0, found=False).collect()}
    assert far == {i for _, i, _ in a_rows} - near
    nearest = {r["ord"]: r["nearest_mm"] for r in nearest_within(a, b, ["case_id"], ["ord"], "p", "q", 2.0).collect()}
    for c, i, p in a_rows:
        best = min((gap(p, q) for d, _, q in b_rows if d == c), default=9e9)
        assert (nearest[i] is None) == (best > 2.0) and (best > 2.0 or abs(nearest[i] - best) < 1e-9)


def test_tolerance_boundary(spark):
    one = spark.createDataFrame([(0, (3.0, 0.0, 0.0)), (1, (3.000001, 0.0, 0.0))], f"k int, p {POINT}")
    zero = spark.createDataFrame([((0.0, 0.0, 0.0),)], f"q {POINT}").withColumn("z", F.lit(1))
    assert [r["k"] for r in pairs_within(one.withColumn("z", F.lit(1)), zero, ["z"], "p", "q", 3.0).collect()] == [0]
    assert pairs_within(one.withColumn("z", F.lit(1)), zero, ["z"], "p", "q", 3.0, inclusive=False).count() == 0


def test_connected_components_against_union_find(spark):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b} | {(200 + i, 201 + i) for i in range(40)}
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame([(0, a, b) for a, b in edges], "case_id int, a int, b int")
    got = graph.connected_components(frame, ["case_id"]).collect()
    assert {r["node"]: r["component"] for r in got} == {v: root(v) for v in parent} and len(got) == len(parent)


@pytest.mark.parametrize("packed", [1000, 3])
@pytest.mark.parametrize("vertices_only", [False, True])
def test_nearest_on_polyline_routes(spark, packed, vertices_only):
    rng = np.random.default_rng(6)
    line = np.cumsum(rng.normal(size=(60, 3)), axis=0)
    rows = [(0, i, *map(float, v)) for i, v in enumerate(line)] + [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, "case_id int, seq bigint, x double, y double, z double")
    wanted = [(int(c), i, tuple(float(v) for v in rng.normal(size=3) * 8)) for i, c in enumerate(rng.integers(0, 3, 60))]
    frame = spark.createDataFrame(wanted, f"case_id int, k int, point {POINT}")
    got = {r["k"]: r for r in polyline.nearest_on_polyline(frame, lines, ["case_id"], ["k"], packed=packed, vertices_only=vertices_only).collect()}
    assert len(got) == 60
    for case, k, p in wanted:
        chain = [np.array(r[2:]) for r in rows if r[0] == case]
        best = None
        for i, (a, b) in enumerate(zip(chain, chain[1:])):
            v = b - a
            t = 0 if vertices_only else min(1, max(0, float(np.dot(np.array(p) - a, v) / np.dot(v, v))))
            d = float(np.linalg.norm(a + t * v - p))
            if best is None or d < best[0] - 1e-12:
                best = (d, i + t)
        if vertices_only and chain:
            d = float(np.linalg.norm(chain[-1] - p))
            best = min(best, (d, len(chain) - 1.0))
        if best is None:
            assert got[k]["nearest_mm"] is None
        else:
            assert abs(got[k]["nearest_mm"] - best[0]) < 1e-9 and abs(got[k]["position"] - best[1]) < 1e-6


def test_long_lines_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(polyline, "CHUNK", 4)
    monkeypatch.setattr(rings, "CHUNK", 4)
    rng = np.random.default_rng(1)
    line = rng.normal(size=(23, 3))
    frame = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(line)], "case_id int, seq bigint, x double, y double, z double")
    arcs = [r["arc"] for r in polyline.arc_length(frame, ["case_id"]).orderBy("seq").collect()]
    assert np.allclose(arcs, np.r_[0, np.cumsum(np.linalg.norm(np.diff(line, axis=0), axis=1))])
    values = [None, None, 4.0, None, None, None, None, None, None, 8.0, None, None, None, None, None, None, None, None, None]
    series = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(1, 0, None)], "case_id int, seq bigint, value double")
    got = rings.fill_gaps(series, ["case_id"]).orderBy("case_id", "seq").collect()
    assert [r["value"] for r in got] == [4.0] * 3 + [6.0] * 6 + [8.0] * 10 + [0.0]


@pytest.mark.parametrize("limit", [10_000, 5])
@pytest.mark.parametrize("recall", [0.0, 0.6])
def test_threshold_selection_against_brute_force(spark, limit, recall):
    rng = np.random.default_rng(9)

    def rows(n):
        return [(float(np.round(rng.random(), 2)), "confirmed" if rng.random() < 0.5 else "rejected") for _ in range(n)]

    val, trn = rows(60), rows(50)

    def f1(data, t):
        tp = sum(s >= t and l == "confirmed" for s, l in data)
        fp = sum(s >= t and l != "confirmed" for s, l in data)
        fn = sum(s < t and l == "confirmed" for s, l in data)
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0

    ts = {0.0, 0.5, 1.0, *(s for s, _ in val)}
    if recall:
        pos = [s for s, l in trn if l == "confirmed"]
        ts = {t for t in ts | set(pos) if sum(s >= t for s in pos) / len(pos) >= recall}
    want = min(sorted(ts), key=lambda t: (-f1(val, t), abs(t - 0.5), t))
    schema = "score double, label string"
    got = training.select_threshold(spark.createDataFrame(val, schema), spark.createDataFrame(trn, schema), recall, limit).first()
    assert got["threshold"] == want and abs(got["f1"] - f1(val, want)) < 1e-12


def test_split_is_deterministic_and_disjoint(spark):
    frame = spark.createDataFrame([(f"case{i % 11}",) for i in range(40)], "case_id string")
    first = {r["case_id"]: r["partition"] for r in training.split_cases(frame, 7).collect()}
    again = {r["case_id"]: r["partition"] for r in training.split_cases(frame.orderBy(F.rand(1)), 7).collect()}
    assert first == again and len(first) == 11
    assert [sum(v == p for v in first.values()) for p in ("train", "validation", "test")] == [7, 2, 2]
    with pytest.raises(ValueError):
        training.split_cases(frame.filter("case_id < 'case3'"), 7)


def test_smoothing_reflects_ends(spark):
    values = [1.0, 5.0, 2.0, 8.0, 3.0]
    frame = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "case_id int, seq bigint, v double")
    got = [r["v"] for r in polyline.smooth_series(frame, ["case_id"], ["v"], 1.0).orderBy("seq").collect()]
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    padded = np.pad(values, 4, mode="symmetric")
    assert np.allclose(got, np.convolve(padded, k / k.sum(), mode="valid"))
    assert list(itertools.islice(got, 1))
