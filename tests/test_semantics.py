"""Hand-made cases with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary.functions import geometry as g, naming as n
from ostiary.functions.features import FEATURE_NAMES, LogisticModel
from ostiary.functions.profiles import profile_configs, review_settings, settings
from ostiary.operators import cells, metrics, polyline, quality, resolve, reviews, rings, training
from ostiary.operators.matching import match_one_to_one
from ostiary.plans import evaluation
from ostiary.sources import files, references

POINT = "struct<x:double,y:double,z:double>"
SIDE = f"case_id string, ord bigint, instance_id string, ostium {POINT}, seed {POINT}, direction {POINT}, radius_mm double"


def side(spark, placed):
    rows = [(case, i, f"b{i}", (x, 0.0, 0.0), (x, 0.0, 5.0), (0.0, 0.0, 1.0), 1.0) for case, xs in placed.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, SIDE)


def evaluate(spark, pred, ref, tolerance):
    names = spark.createDataFrame([(c,) for c in {*pred, *ref}], "case_id string")
    per_case, matches = evaluation.evaluate(names, side(spark, pred), side(spark, ref), [tolerance])
    return per_case, matches


@pytest.mark.parametrize("pred,ref,tol,want", [
    ([0.0, 1.0, 30.0], [0.0, 60.0], 5.0, (1, 2, 1, 1 / 3, 0.5)),
    ([], [0.0], 5.0, (0, 0, 1, None, 0.0)),
    ([], [], 5.0, (0, 0, 0, None, None)),
    ([0.0, 4.0], [3.0, 7.0], 4.0, (2, 0, 0, 1.0, 1.0)),
    ([3.0], [0.0], 3.0, (1, 0, 0, 1.0, 1.0)),
    ([3.000001], [0.0], 3.0, (0, 1, 1, 0.0, 0.0)),
])
def test_case_metrics(spark, pred, ref, tol, want):
    r = evaluate(spark, {"a": pred}, {"a": ref}, tol)[0].first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == want
    assert r["f1"] == (None if not pred and not ref else 2 * want[0] / (2 * want[0] + want[1] + want[2]))


def test_count_errors_and_controls(spark):
    per_case, _ = evaluate(spark, {"a": [0.0, 9.0, 18.0], "b": [0.0], "d": [1.0]}, {"a": [0.0], "b": [0.0, 9.0, 18.0]}, 3.0)
    r = metrics.summarize(per_case.filter("case_id in ('a', 'b')")).first()
    assert (r["count_mae"], r["overcount_cases"], r["undercount_cases"]) == (2.0, 1, 1)
    s = metrics.summarize(per_case).first()
    assert (s["negative_cases"], s["negative_cases_with_fp"], s["negative_fp"]) == (1, 1, 1)


def test_micro_average(spark):
    rows = spark.createDataFrame([(1, 0, 0), (0, 9, 3)], "tp int, fp int, fn int")
    r = metrics.summarize(rows).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.1, 0.25, 2 / 14)


def test_tolerances_are_checked(spark):
    with pytest.raises(ValueError):
        match_one_to_one(side(spark, {"a": [0.0]}), side(spark, {"a": [0.0]}), [0.0])
    with pytest.raises(ValueError):
        quality.validate_threshold(float("nan"))


def test_mirror_check(spark):
    pred, ref = side(spark, {"a": [10.0, 20.0, 30.0]}), side(spark, {"a": [-10.0, -20.0, -30.0]})
    names = spark.createDataFrame([("a",)], "case_id string")
    r = metrics.mirror_check(names, pred, ref, match_one_to_one(pred, ref, [3.0]), 3.0).first()
    assert (r["tp"], r["mirror_tp"], r["mirror_suspected"]) == (0, 3, True)


def path_frame(spark, points):
    return spark.createDataFrame([("p", [tuple(map(float, p)) for p in points])], f"k string, path array<{POINT}>").withColumn(
        "arcs", g.arc_lengths(F.col("path")))


def test_truncate_and_interpolate(spark):
    frame = path_frame(spark, [(0, 0, 0), (3, 0, 0), (3, 4, 0)])
    cut = frame.select(g.truncate_path(F.col("path"), F.col("arcs"), F.lit(5.0)).alias("c")).first()["c"]
    assert [tuple(p) for p in cut] == [(0, 0, 0), (3, 0, 0), (3, 2, 0)]
    assert len(frame.select(g.truncate_path(F.col("path"), F.col("arcs"), F.lit(7.0)).alias("c")).first()["c"]) == 3
    assert tuple(frame.select(g.point_at_arc(F.col("path"), F.col("arcs"), F.lit(1.0)).alias("c")).first()["c"]) == (1, 0, 0)
    assert tuple(frame.select(g.point_at_arc(F.col("path"), F.col("arcs"), F.lit(0.0)).alias("c")).first()["c"]) == (0, 0, 0)


def test_stop_at_first_junction(spark):
    paths = path_frame(spark, [(i, 0, 0) for i in range(11)]).withColumn("case_id", F.lit(1)).select("case_id", "k", "path")
    places = spark.createDataFrame([(1, (9.0, 0.0, 0.0)), (1, (7.0, 0.0, 0.0)), (1, (2.0, 4.0, 0.0)), (1, (0.0, 0.0, 0.0))], f"case_id int, junction {POINT}")
    out = polyline.stop_at_junction(paths, places, ["case_id"], ["k"], 1.5).first()["path"]
    assert tuple(out[-1]) == (7, 0, 0) and len(out) == 8


def test_shared_trunks(spark):
    def pair(a, b, ra=1.0, rb=1.0):
        row = ([tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b], ra, rb)
        frame = spark.createDataFrame([row], f"a array<{POINT}>, b array<{POINT}>, ra double, rb double")
        for s in "ab":
            frame = frame.withColumn(f"{s}_arcs", g.arc_lengths(F.col(s))).withColumn(
                f"{s}_prefix", g.truncate_path(F.col(s), F.col(f"{s}_arcs"), F.lit(3.0)))
        return frame.select(polyline.same_trunk(*[F.col(c) for c in ("a", "a_prefix", "ra", "b", "b_prefix", "rb")]).alias("t")).first()["t"]

    straight = [(0, 0, 0), (0, 0, 5), (0, 0, 10)]
    assert pair(straight, [(1, 0, 0), (1, 0, 5), (5, 0, 10)])
    assert not pair(straight, [(4, 0, 0), (4, 0, 5)])
    assert pair(straight, [(4, 0, 0), (4, 0, 5)], ra=3.5)


def test_ray_crossings(spark):
    flat = [10.0] * 40
    falling = [10.0, 8.0, 4.0, 0.0] + [0.0] * 30
    low = [1.0, 9.0]
    rows = [(0, r, falling if r % 16 < 12 else flat) for r in range(32)] + [(1, r, falling if r % 16 < 11 else flat) for r in range(32)]
    rows += [(2, r, low if r == 0 else falling) for r in range(32)]
    crossed = polyline.first_crossing(spark.createDataFrame(rows, "s int, ray int, samples array<double>"), 6.0)
    values = {r["s"]: r["radius_mm"] for r in polyline.cross_section_radius(crossed, ["s"]).collect()}
    assert values == {0: 0.375, 1: None, 2: None}


def test_wall_crossing(spark):
    rows = [(0, [2.0, 1.0, -1.0], [True, True, True]), (1, [2.0, 1.0, -1.0], [True, False, True]), (2, [-1.0, 1.0], [True, True]), (3, [2.0, 1.0], [True, True])]
    frame = spark.createDataFrame(rows, "k int, samples array<double>, supported array<boolean>")
    got = {r["k"]: r["crossing_at"] for r in polyline.wall_crossing(frame, 0.0).collect()}
    assert got == {0: 1.5, 1: None, 2: None, 3: None}
    loose = {r["k"]: r["crossing_at"] for r in polyline.wall_crossing(frame, 0.35).collect()}
    assert loose[1] == 1.5


def test_self_check(spark):
    good = [(0.0, 0.0, float(i)) for i in range(11)]
    rows = [("ok", good, (0.0, 0.0, 5.0), (0.0, 0.0, 1.0), 2.0), ("turned", good, (0.0, 0.0, 5.0), (1.0, 0.0, 0.0), 2.0),
            ("off", good, (3.0, 0.0, 5.0), (0.0, 0.0, 1.0), 2.0), ("thin", good, (0.0, 0.0, 5.0), (0.0, 0.0, 1.0), 1.2),
            ("point", [(0.0, 0.0, 0.0)], (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), 2.0), ("none", [], (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), 2.0)]
    frame = spark.createDataFrame(rows, f"k string, path array<{POINT}>, seed {POINT}, direction {POINT}, radius_mm double")
    got = {r["k"]: r["warnings"] for r in quality.self_check(frame).collect()}
    assert got == {"ok": [], "turned": ["direction_diverges"], "off": ["seed_off_path"], "thin": ["radius_near_limit"], "point": [], "none": ["seed_off_path"]}


def brute_resolve(rows, parallel, cap=160):
    def dist(a, b):
        return math.dist(a, b)

    def cut(path, length):
        out, walked = [path[0]], 0.0
        for a, b in zip(path, path[1:]):
            step = dist(a, b)
            if walked + step >= length:
                t = (length - walked) / step
                return out + [tuple(p + t * (q - p) for p, q in zip(a, b))]
            out.append(b)
            walked += step
        return path

    def off(p, path):
        best = 9e9
        for a, b in zip(path, path[1:]):
            v = np.subtract(b, a)
            t = min(1, max(0, float(np.dot(np.subtract(p, a), v)) / max(float(np.dot(v, v)), 1e-8)))
            best = min(best, dist(tuple(np.add(a, t * v)), p))
        return best

    def trunk(a, b):
        return any(all(off(p, y["path"]) <= max(1.5, 1.2 * y["r"]) for p in cut(x["path"], 3.0)) for x, y in ((a, b), (b, a)))

    def lies_on(a, b):
        return any(dist(p, q) < 1.5 for p in a["path"][:2] for q in b["path"][1:])

    kept, reasons = [], {}
    for row in sorted(rows, key=lambda r: (-r["r"], r["path"][0][2], r["path"][0][1], r["path"][0][0]))[:cap]:
        reason = None
        for old in kept:
            d = dist(row["path"][0], old["path"][0])
            if d >= max(2.5, row["r"] + old["r"]):
                continue
            if d < 2.5 and dist(row["seed"], old["seed"]) < 3:
                reason = "same_opening_and_path"
                break
            if trunk(row, old):
                reason = "common_trunk"
                break
        if reason is None and parallel:
            if any(lies_on(row, old) for old in kept):
                reason = "opening_on_another_path"
            else:
                for old in [o for o in kept if lies_on(o, row)]:
                    kept.remove(old)
                    reasons[old["id"]] = "opening_on_another_path"
        if reason:
            reasons[row["id"]] = reason
        else:
            kept.append(row)
    return reasons


@pytest.mark.parametrize("parallel", [0.0, 2.5])
def test_resolution_equals_sequential_walk(spark, parallel):
    rng = np.random.default_rng(21)
    by_case, table = {}, []
    for case in range(6):
        for i in range(25):
            start = rng.random(3) * 9
            path = [tuple(float(v) for v in start)]
            for _ in range(4):
                path.append(tuple(float(v) for v in np.add(path[-1], rng.normal(size=3) * 1.5)))
            row = {"id": f"{case}-{i}", "r": float(0.8 + rng.random() * 2), "path": path, "seed": path[2]}
            by_case.setdefault(case, []).append(row)
            table.append((case, row["id"], row["r"], path[0], row["seed"], path))
    frame = spark.createDataFrame(table, f"case_id int, id string, radius_mm double, ostium {POINT}, seed {POINT}, path array<{POINT}>")
    order = [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]
    got = resolve.resolve_candidates(frame, ["case_id"], order, parallel_clearance=parallel).collect()
    want = {}
    for rows in by_case.values():
        want.update(brute_resolve(rows, parallel))
    assert len(got) == len(table)
    assert {r["id"]: r["reason"] for r in got if r["reason"]} == want
    assert {"common_trunk", "same_opening_and_path"} <= set(want.values())


def grid(spark, members):
    return spark.createDataFrame(members, "case_id int, z int, y int, x int, parent boolean, support boolean, excluded boolean")


def test_root_relocation(spark):
    parent = [(0, z, 7, x, True, True, False) for z in range(20) for x in (0, 1, 2, 3)]
    bent = [(0, 12, 7, 4), (0, 12, 7, 5), (0, 12, 8, 5), (0, 12, 9, 5), (0, 12, 9, 6)]
    rows = parent + [(*c, False, True, False) for c in bent]
    roots = spark.createDataFrame([(0, 1, 12, 9, 6)], "case_id int, root_id int, z int, y int, x int")
    r = cells.relocate_root(roots, grid(spark, rows)).first()
    assert tuple(r["relocated"]) == (12, 7, 4) and r["walk_mm"] == 4.0
    broken = [row for row in rows if row[:4] != (0, 12, 8, 5)]
    assert cells.relocate_root(roots, grid(spark, broken)).first()["relocated"] is None
    capped = [(*row[:6], row[:4] == (0, 12, 7, 4)) for row in rows]
    assert cells.relocate_root(roots, grid(spark, capped)).first()["relocated"] is None
    assert cells.relocate_root(roots, grid(spark, rows), maximum=3.0).first()["relocated"] is None


def test_junctions_of_a_cross_and_a_line(spark):
    line = [(0, 0, 10, x, False) for x in range(21)]
    crossing = [(1, 0, 10, x, False) for x in range(21)] + [(1, 0, y, 10, False) for y in range(11, 21)]
    frame = spark.createDataFrame(line + crossing, "case_id int, z int, y int, x int, parent boolean")
    found = cells.junctions(frame).collect()
    assert [r["case_id"] for r in found] == [1] and found[0]["arms"] == 3
    assert abs(found[0]["centre"]["x"] - 10) < 0.5


def test_principal_axis_against_svd(spark):
    rng = np.random.default_rng(0)
    data = {k: rng.normal(size=(50, 3)) * [1, 3 + k, 0.5] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for k in range(4)}
    rows = [(k, *map(float, v)) for k, vs in data.items() for v in vs]
    got = cells.principal_axis(spark.createDataFrame(rows, "case_id int, x double, y double, z double"), ["case_id"]).collect()
    for r in got:
        points = data[r["case_id"]]
        want = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)[2][0]
        axis = np.array([r["axis"][c] for c in "xyz"])
        assert abs(abs(float(want @ axis)) - 1) < 1e-9
        assert abs((r["high"] - r["low"]) - np.ptp(points @ want)) < 1e-6


def test_slice_curve_stays_inside(spark):
    rows = [(0, z, y, x, True, float(2 - max(abs(y - 5), abs(x - 5)) + 1)) for z in range(12) for y in range(3, 8) for x in range(3, 8)]
    frame = spark.createDataFrame(rows, "case_id int, z int, y int, x int, parent boolean, inside double")
    got = cells.slice_curve(frame).orderBy("level").collect()
    assert len(got) == 12 and all(abs(r["y"] - 5) < 1e-9 and abs(r["x"] - 5) < 1e-9 for r in got)


def test_five_reference_layouts(spark, tmp_path):
    case = {"daughters": [{"id": "a", "ostium": [1, 2, 3], "seed": {"x": 1, "y": 2, "z": 8}, "diameter_mm": 4}]}
    layouts = {
        "one": dict(case, case_id="case_7"), "list": [dict(case, subject="8"), dict(case, subject=9)],
        "wrapped": {"cases": [dict(case, id="subject010")]}, "keyed": {"orig11.nii.gz": case, "note": "text"}, "subject012": case,
    }
    for name, value in layouts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    rows = references.normalize_references(references.read_landmark_sets(spark, str(tmp_path))).collect()
    assert sorted(r["case_id"] for r in rows) == [f"subject{i:03d}" for i in range(7, 13)]
    for r in rows:
        assert r["problem"] is None and r["instance_id"] == "a" and r["radius_mm"] == 2.0 and r["radius_known"]
        assert tuple(r["seed"]) == (1, 2, 8) and tuple(r["direction"]) == (0, 0, 1)
        assert any("diameter halved" in t for t in r["notes"])


def test_reference_problems_and_voxels(spark):
    documents = [
        ({"scope": "unreviewed_proposals_not_ground_truth", "case_id": "1", "daughters": []}, "unreviewed_proposals"),
        ({"case_id": "2", "daughters": [{"seed": [0, 0, 1]}]}, "no_ostium"),
        ({"case_id": "3", "daughters": [{"ostium": [0, 0, 1]}]}, "no_direction_or_seed"),
        ({"case_id": "4", "daughters": [{"ostium": [0, 0, 1], "direction": [0, 0, 0]}]}, "zero_direction"),
        ({"case_id": "5", "daughters": [{"ostium_voxel": [2, 4, 1], "seed": [2, 4, 2]}]}, None),
        ({"case_id": "6", "daughters": [{"ostium": [0, 0], "direction": [0, 0, 1]}]}, "bad_ostium"),
        ({"case_id": "7", "daughters": {"x": {"ostium": [0, 0, 1], "direction": [0, 0, 2], "radius_mm": None}}}, None),
        ({"case_id": "8", "daughters": [{"id": "k", "ostium": [0, 0, 1], "direction": [0, 0, 1]}] * 2}, None),
    ]
    frame = spark.createDataFrame([(json.dumps(d), f"f{i}") for i, (d, _) in enumerate(documents)], "text string, stem string")
    headers = spark.createDataFrame([("subject005", [-10.0, 20.0, 100.0], [0.5, 0.5, 2.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])],
                                    "case_id string, origin array<double>, spacing array<double>, direction array<double>")
    rows = references.normalize_references(references.split_documents(frame), headers).collect()
    found = {r["case_id"]: r for r in rows}
    for i, (_, problem) in enumerate(documents, 1):
        assert found[f"subject{i:03d}"]["problem"] == problem
    assert tuple(found["subject005"]["ostium"]) == (-9, 22, 102) and tuple(found["subject005"]["seed"]) == (-9, 22, 104)
    assert found["subject007"]["instance_id"] == "x" and not found["subject007"]["radius_known"] and found["subject007"]["radius_mm"] == 1.0
    assert sorted(r["instance_id"] for r in rows if r["case_id"] == "subject008") == ["k_001", "k_002"]


def test_case_names(spark):
    names = {"subject7": "subject007", "CASE_0012.nii.gz": "subject012", "c-5": "subject005", "1234": "subject1234", "patient 7": "patient 7",
             "case_": "case_", "case7\n": "case7\n"}
    frame = spark.createDataFrame(list(names.items()), "raw string, want string")
    assert frame.filter(n.normalize_case_id(F.col("raw")) != F.col("want")).count() == 0


def test_predictions_round_trip_and_write_once(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("empty",)], "case_id string")
    target = str(tmp_path / "out")
    files.write_predictions(names, side(spark, {"a": [1.0, 2.0]}), target)
    rows, found = files.read_predictions(spark, target, lines=True)
    assert {r[0] for r in found.collect()} == {"a", "empty"} and rows.count() == 2
    assert {r["ostium"]["x"] for r in rows.collect()} == {1.0, 2.0}
    with pytest.raises(Exception, match="already exists"):
        files.write_predictions(names, side(spark, {"a": [1.0]}), target)
    split = files.prediction_records(names, side(spark, {"a": [1.0, 2.0, 3.0]}), rows_per_record=2).filter("case_id = 'a'")
    assert sorted((r["part"], r["parts"], len(r["daughters"])) for r in split.collect()) == [(0, 2, 2), (1, 2, 1)]
    whole = files.prediction_records(names, side(spark, {"a": [1.0]})).collect()
    assert {(r["case_id"], r["part"], r["parts"], len(r["daughters"])) for r in whole} == {("a", 0, 1, 1), ("empty", 0, 1, 0)}


def test_model_round_trip(spark, tmp_path):
    k = len(FEATURE_NAMES)
    model = LogisticModel([0.5] * k, [2.0] * k, [0.1] * k, -1.0, 0.4, {"train": ["a"], "validation": ["b"], "test": ["c"]})
    target = str(tmp_path / "model")
    files.save_model(spark, model, target)
    assert files.load_model(spark, target) == model
    with pytest.raises(ValueError):
        files.load_model(spark, target, "0" * 64)
    broken = LogisticModel([0.5] * k, [0.0] * k, [0.1] * (k - 1), -1.0, 1.4, {"train": ["a"], "validation": ["a"], "test": ["c"]})
    rules = {r["rule"] for r in files.model_violations(files.model_record(spark, broken)).collect()}
    assert rules == {"vectors", "scale", "threshold", "split"}


def test_case_folders_and_pointers(spark, tmp_path):
    for case, names in {"s1": ["orig1.nii", "mask1.nii.gz"], "s2": ["orig2.nii", "orig2b.nii", "mask2.nii"]}.items():
        (tmp_path / case).mkdir()
        for name in names:
            (tmp_path / case / name).write_bytes(b"version https://git-lfs.github.com/spec/v1\n" if name == "mask2.nii" else b"\x1f\x8b\x08data")
    found = files.read_files(spark, str(tmp_path))
    assert {r["case_id"]: r["status"] for r in files.scan_cases(found).collect()} == {"s1": "ok", "s2": "failed"}
    ready = files.file_availability(found, F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1))
    assert {r["case_id"]: (r["available"], r["gzipped"]) for r in ready.collect()} == {"s1": (True, 2), "s2": (False, 2)}
    (tmp_path / "sums.txt").write_text("ab12  x/y.nii\n\n")
    assert [tuple(r) for r in files.read_checksum_list(spark, str(tmp_path / "sums.txt")).collect()] == [("x/y.nii", "ab12")]


def test_training_ignores_test_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for case in range(12):
        for i in range(14):
            label = i % 2
            rows.append((f"c{case}", f"i{i}", "confirmed" if label else "rejected", [float(v) for v in rng.normal(size=13) + label * 0.8]))
    schema = "case_id string, instance_id string, label string, features array<double>"
    split = spark.createDataFrame([(f"c{i}", "train" if i < 8 else "validation" if i < 10 else "test") for i in range(12)], "case_id string, partition string")
    model, report = training.train(spark.createDataFrame(rows, schema), split, 0.5)
    changed = [(c, i, l, [v * 50 for v in f] if c in ("c10", "c11") else f) for c, i, l, f in rows]
    other, _ = training.train(spark.createDataFrame(changed, schema), split, 0.5)
    assert np.allclose(model.weights, other.weights) and model.threshold == other.threshold
    x = np.array([f for c, _, _, f in rows if int(c[1:]) < 8])
    y = np.array([l == "confirmed" for c, _, l, _ in rows if int(c[1:]) < 8], dtype=float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    residual = 1 / (1 + np.exp(-(z @ model.weights + model.bias))) - y
    assert np.abs(np.r_[z.T @ residual / len(y) + 0.1 * np.array(model.weights), residual.mean()]).max() < 1e-4
    assert report.count() == 6
    with pytest.raises(ValueError, match="case_in_two_partitions"):
        training.train(spark.createDataFrame(rows, schema), split.unionByName(split.filter("case_id = 'c1'").withColumn("partition", F.lit("test"))))


def test_review_upsert_and_conflicts(spark):
    rows = [("a", "1", "confirmed", 1, 1), ("a", "1", "rejected", 2, 2), ("a", "2", "confirmed", 1, 3), ("a", "2", "unreviewed", 5, 4)]
    frame = spark.createDataFrame(rows, "case_id string, instance_id string, label string, reviewed_at int, event_id int")
    assert [(r["instance_id"], r["label"]) for r in reviews.upsert_reviews(frame).collect()] == [("1", "rejected")]
    unique, clash = reviews.dedupe_reviews(frame.select("case_id", "instance_id", "label").unionByName(
        spark.createDataFrame([("b", "1", "rejected")] * 3, "case_id string, instance_id string, label string")))
    assert [(r["case_id"], r["instance_id"]) for r in unique.collect()] == [("b", "1")] and clash.count() == 2


def test_profiles(spark):
    assert quality.validate_config(profile_configs(spark)).count() == 0
    strict = settings("strict", {"minimum_radius_mm": 0.9, "native_contrast_scale": 0.9})
    review = review_settings(strict)
    assert review["minimum_radius_mm"] == 0.9 and review["shell_outer_mm"] == 6.0 and review["minimum_origin_diameter_mm"] == 2.0
    bad = profile_configs(spark, {"finer": {"spacing_mm": 0.0}, "relaxed": {"trace_length_mm": 11.0}})
    assert {(r["profile"], r["rule"]) for r in quality.validate_config(bad).collect()} == {("finer", "positive"), ("relaxed", "lengths")}


def test_ring_ranges(spark):
    radius = spark.createDataFrame([(0, i, float(i)) for i in range(10)] + [(1, 0, 3.0)], "case_id int, seq bigint, radius double")
    centres = spark.createDataFrame([(0, 2.6), (1, 0.0)], "case_id int, seq double")
    got = rings.trimmed_range(radius, centres, ["case_id"], window=1, low=0.0, high=1.0).collect()
    low = {r["case_id"]: (r["low"], r["high"]) for r in got}
    assert low == {0: (0.0, 9.0), 1: (3.0, 3.0)}
    got = rings.trimmed_range(radius, spark.createDataFrame([(0, 1.0)], "case_id int, seq double"), ["case_id"], window=1, low=0.0, high=1.0)
    assert {(r["low"], r["high"]) for r in got.filter("case_id = 0").collect()} == {(3.0, 9.0)}
