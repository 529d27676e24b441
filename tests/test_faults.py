"""Faults found in review: real files, missing features, bad points, repeated names, hot groups, workers."""

import json
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary import scale
from ostiary.functions.features import CONTEXT_FEATURES, LogisticModel
from ostiary.operators import cells, matching, polyline, resolve
from ostiary.plans import workflow
from ostiary.sources import adapters, files, references

POINT = "struct<x:double,y:double,z:double>"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


def test_indented_prediction_files(spark, tmp_path):
    for case, count in (("a", 2), ("b", 0)):
        branch = {"instance_id": "branch_001", "parent_instance_id": "aorta", "ostium_xyz_mm": [1, 2, 3], "seed_xyz_mm": [1, 2, 8],
                  "radius_mm": 2.0, "direction_xyz": [0, 0, 1]}
        record = {"case_id": case, "parent": {"instance_id": "aorta"}, "daughters": [branch] * count}
        (tmp_path / case).mkdir()
        (tmp_path / case / "prediction.json").write_text(json.dumps(record, indent=2))
    rows, found = files.read_predictions(spark, str(tmp_path))
    assert {r[0] for r in found.collect()} == {"a", "b"}
    assert [(r["case_id"], r["ostium"]["z"], r["direction"]["z"]) for r in rows.collect()] == [("a", 3.0, 1.0)] * 2
    (tmp_path / "broken.json").write_text('{"case_id": "c", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_predictions(spark, str(tmp_path))[1].collect()


MODEL = LogisticModel([0.0] * 13, [1.0] * 13, [0.1] * 13, 0.0, 0.3)


def test_missing_features_are_no_low_score(spark):
    rows = adapters.candidates(spark, FOLDER).limit(40)
    broken = F.when(F.col("ord") % 2 == 0, F.map_filter("features", lambda k, v: k != CONTEXT_FEATURES[5])).otherwise(F.col("features"))
    rows = scale.checkpoint(rows.withColumn("features", broken))
    strict, review = rows.filter("profile = 'strict'"), rows.filter("profile = 'review'")
    log = workflow.score_before_merge(strict, review, MODEL).collect()
    assert len(log) == 40 and {r["decision"] for r in log if r["score"] is None} == {"invalid_features"}
    assert all(r["score"] is not None for r in log if r["decision"] != "invalid_features")
    with pytest.raises(ValueError, match="invalid_features"):
        workflow.score_before_merge(strict, review, MODEL, require=True)
    with pytest.raises(ValueError):
        workflow.score_before_merge(strict, review, MODEL, threshold=5)
    with pytest.raises(ValueError):
        workflow.strict_only(strict, None, 0.5)


def test_points_without_a_place(spark):
    line = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(60)] + [("a", 60, 50_000.0, 0.0, 0.0)], "case_id string, seq int, x double, y double, z double")
    nan = float("nan")
    places = [(0, (3.4, 1.0, 0.0)), (1, (nan, 0.0, 0.0)), (2, None), (3, (float("inf"), 0.0, 0.0)), (4, (25_000.0, 2.0, 0.0)), (5, (20.0, 300.0, 0.0))]
    points = spark.createDataFrame([("a", i, p) for i, p in places], f"case_id string, id int, point {POINT}")
    for packed in (8, 512):
        rows = {r["id"]: r for r in polyline.nearest_on_polyline(points, line, ["case_id"], ["id"], packed=packed).collect()}
        assert len(rows) == 6 and all(rows[i]["nearest_mm"] is None for i in (1, 2, 3))
        assert rows[0]["position"] == pytest.approx(3.4) and rows[5]["nearest_mm"] == pytest.approx(300)
        assert rows[4]["nearest_mm"] == pytest.approx(2) and rows[4]["position"] == pytest.approx(59 + (25_000 - 59) / (50_000 - 59))


def test_records_are_known_by_path(spark, tmp_path):
    for folder, ids in (("a", ["x"]), ("b", ["x"]), ("c", ["y", "y"])):
        daughters = [{"id": i, "ostium": [1, 2, 3], "seed": [1, 2, 8]} for i in ids]
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "ref.json").write_text(json.dumps({"case_id": f"case_{ord(folder)}", "daughters": daughters}))
    rows = references.normalize_references(references.read_landmark_sets(spark, str(tmp_path))).collect()
    assert len({r["record"] for r in rows}) == 3
    assert sorted(r["instance_id"] for r in rows) == ["x", "x", "y_001", "y_002"]
    assert all(any("identifiers repeat" in t for t in r["notes"]) == r["instance_id"].startswith("y") for r in rows)


def test_default_ids_beyond_999(spark):
    daughters = [{"ostium": [1, 2, 3], "seed": [1, 2, 8]} for _ in range(1_002)]
    text = json.dumps({"case_id": "7", "daughters": daughters})
    rows = references.normalize_references(references.split_documents(spark.createDataFrame([(text, "s")], "text string, stem string"))).collect()
    assert {r["instance_id"] for r in rows} == {f"reference_{i:03d}" for i in range(1, 1_003)}


def test_rows_over_the_candidate_limit_stay(spark):
    rows = adapters.candidates(spark, FOLDER)
    order = [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]
    free = resolve.resolve_candidates(rows, ["case_id"], order)
    assert free.count() == rows.count() and free.filter("reason = 'over_candidate_limit'").count() == 0
    capped = resolve.resolve_candidates(rows, ["case_id"], order, cap=2)
    assert capped.count() == rows.count()
    assert capped.filter("(rank > 2) <> (reason <=> 'over_candidate_limit')").count() == 0


@pytest.mark.parametrize("limit", [10_000, 50])
def test_per_group_values(spark, monkeypatch, limit):
    """Only rows of the hot group are salted, and no row is lost or repeated."""
    monkeypatch.setattr(scale, "HOT_ROWS", limit)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "case_id int, v int")
    table = rows.groupBy("case_id").agg(F.max("v").alias("top"))
    got = scale.per_group(rows, table, ["case_id"])
    assert got.count() == 300 and got.filter("top < v").count() == 0
    plan = got.groupBy("case_id").count()._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (limit == 50) and "hashpartitioning(case_id" in plan  # the aggregate has a shuffle of its own
    if limit == 50:
        assert [r["case_id"] for r in scale.hot_keys(rows, ["case_id"]).collect()] == [1]
        spread = got.repartition(64, "case_id", F.pmod(F.xxhash64("case_id", "v"), F.lit(scale.SALTS)))  # the salt's tasks
        assert max(len(p) for p in spread.rdd.glom().collect()) < 0.2 * 300
        assert scale.per_group(rows, table.filter("case_id <> 1"), ["case_id"], "left").filter("top IS NULL").count() == 200
    else:
        assert scale.hot_keys(rows, ["case_id"]) is None


def test_core_queries_register_without_text_libraries():
    """A text library that is missing costs the text queries alone."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    count, text, sql = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(count) > 130 and text == "False" and int(sql) > 120


def test_components_by_tasks_and_by_stars(spark, monkeypatch):
    """Random graphs in groups of different sizes, with plain and struct nodes, by either route and by both."""
    import random

    from ostiary.operators import graph

    rng = random.Random(1)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g, n in ((1, 40), (2, 90), (None, 20), (7, 3)) for _ in range(n)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, x, y in edges:
        if g is not None and x != y:
            lo, hi = sorted((root((g, x)), root((g, y))))
            parent[hi] = lo
    want = sorted((g, n, root((g, n))[1]) for g, n in parent)
    frame = spark.createDataFrame(edges, "g int, a long, b long").filter("g IS NOT NULL")
    for task in (0, 50, 1_000):
        monkeypatch.setattr(graph, "TASK_LINKS", task)
        assert sorted(tuple(r) for r in graph.connected_components(frame, ["g"]).collect()) == want
        cell = F.struct(F.lit(1).alias("z"), (F.col("a") % 8).alias("y"), F.col("a").alias("x")), F.struct(F.lit(1).alias("z"), (F.col("b") % 8).alias("y"), F.col("b").alias("x"))
        cells_ = graph.connected_components(frame.select("g", cell[0].alias("a"), cell[1].alias("b")), ["g"]).collect()
        groups, wanted = {}, {}
        for r in cells_:
            groups.setdefault((r["g"], tuple(r["component"])), set()).add(r["node"]["x"])
        for g, n, c in want:
            wanted.setdefault((g, c), set()).add(n)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
        assert all((c[1], c[2]) == min((n % 8, n) for n in nodes) for (_, c), nodes in groups.items())
        assert graph.connected_components(frame.limit(0), ["g"]).count() == 0 and graph.connected_components(frame.limit(0).select("a", "b"), []).count() == 0


@pytest.mark.parametrize("block", [2, 16, 1_000])
def test_cap_slabs_in_blocks(spark, monkeypatch, block):
    """Slabs of two components, one long and one at negative coordinates, by any size of block."""
    monkeypatch.setattr(cells, "SLAB_BLOCK", block)
    parent = [(0, z, y, 0) for z in range(30) for y in range(3)] + [(0, -20, y, x) for y in range(2) for x in range(-40, -20)] + [(0, 90, 90, 90)]
    other = [(0, z, 5, 4) for z in range(-10, 45)] + [(0, -20, 3, x) for x in range(-50, -10)] + [(1, 0, 0, 0)]
    table = spark.createDataFrame([(*c, True) for c in parent] + [(*c, False) for c in other], "case_id int, z int, y int, x int, parent boolean")
    got = {(r["case_id"], r["z"], r["y"], r["x"]): r["excluded"] for r in cells.cap_cells(table, 2.0, 4.0).collect()}

    def inside(case, z, y, x):
        if case:
            return False
        first = -4 <= z <= 33 and -4 <= y <= 6 and -4 <= x <= 4 and (z < 2 or z > 27)
        second = -24 <= z <= -16 and -4 <= y <= 5 and -44 <= x <= -17 and (x < -38 or x > -23)
        return first or second

    assert got == {c: inside(*c) for c in parent + other}


def test_hub_links_stay_spread(spark, monkeypatch):
    from ostiary.operators import graph

    edges = [(0, i) for i in range(1, 400)] + [(i, i + 400) for i in range(1, 100)] + [(9_000, 9_001), (9_001, 9_002)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {n: 0 for e in edges for n in e if n < 9_000} | {9_000: 9_000, 9_001: 9_000, 9_002: 9_000}
    for limit, task in ((10, 0), (10_000, 0), (10, 20_000)):
        monkeypatch.setattr(graph, "HUB_LINKS", limit)
        monkeypatch.setattr(graph, "TASK_LINKS", task)
        assert {r["node"]: r["component"] for r in graph.connected_components(frame, []).collect()} == want
    assert graph._busiest(frame.toDF("u", "v"), []) == 399


@pytest.mark.parametrize("limit", [100_000, 100])
def test_axis_of_a_hot_case(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "HOT_ROWS", limit)
    rng = np.random.default_rng(3)
    points = [(int(i % 3 == 0) * (i % 50), *map(float, rng.normal(size=3) * (5, 1, 0.5))) for i in range(3_000)]
    table = spark.createDataFrame(points, "case_id int, x double, y double, z double")
    rows = cells.principal_axis(table, ["case_id"]).collect()
    for row in rows:
        own = np.array([p[1:] for p in points if p[0] == row["case_id"]])
        axis = np.linalg.eigh(np.cov(own.T))[1][:, -1]
        assert abs(float(axis @ np.array(row["axis"]))) == pytest.approx(1)
        along = own @ np.array(row["axis"])
        assert (row["low"], row["high"]) == (pytest.approx(along.min()), pytest.approx(along.max()))


def test_solver_on_many_pairs_is_optimal_and_quick():
    rng = np.random.default_rng(4)
    import itertools

    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        pairs = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.7]
        if not pairs:
            continue
        cost = rng.random(len(pairs)).round(1)
        chosen = matching.assign(*np.array(pairs).T, cost)
        best = max(((len(s), -sum(cost[list(s)])) for k in range(len(pairs) + 1) for s in itertools.combinations(range(len(pairs)), k)
                    if len({pairs[e][0] for e in s}) == len({pairs[e][1] for e in s}) == k))
        assert (len(chosen), -cost[chosen].sum()) == (best[0], pytest.approx(best[1]))
    left = np.repeat(np.arange(400), 50)
    right = (left * 3 + np.tile(np.arange(50), 400)) % 450
    chosen = matching.assign(left, right, rng.random(20_000))
    assert len(chosen) == 400


def test_workers_find_the_package(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util, tempfile
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("__spark_entry__", {ROOT!r} + "/__spark_entry__.py")
        entry = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(entry)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
        print("ROWS", entry.queries()["principal_axis"](spark, {FOLDER!r}).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
