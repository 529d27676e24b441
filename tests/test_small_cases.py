"""Cases of a few rows are handled by the case alone, with the results of the routes for large ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary.functions.features import CONTEXT_FEATURES, LogisticModel
from ostiary.operators import polyline, resolve, spatial
from ostiary.plans import workflow

POINT = "struct<x:double,y:double,z:double>"
MODEL = LogisticModel([0.0] * 13, [1.0] * 13, [1.0] + [0.0] * 12, -3.0, threshold=0.5)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def branches(spark, sizes=(1, 4, 7, 30), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for case, size in enumerate(sizes):
        for i in range(size):
            start = rng.random(3) * 6
            steps = rng.normal(size=(3, 3)) * 1.5
            path = [tuple(float(v) for v in p) for p in (start, *(start + np.cumsum(steps, axis=0)))]
            rows.append((case, f"b{i}", path[0], path[2], float(0.5 + 2 * rng.random()), path))
    return spark.createDataFrame(rows, f"case_id int, instance_id string, ostium {POINT}, seed {POINT}, radius_mm double, path array<{POINT}>")


def test_score_is_computed_once(spark):
    rows = branches(spark).select("*", F.lit(0.5).alias("mean_vesselness"), F.lit(0.5).alias("evidence_score"), F.create_map(
        *[x for k in CONTEXT_FEATURES for x in (F.lit(k), F.rand(1))]).alias("features"))
    kept = workflow.threshold_filter(workflow.score_candidates(rows, MODEL), 0.5)
    assert plan(kept).count("aggregate(") == 1
    assert kept.count() == rows.filter("radius_mm >= 3").count()
    assert workflow.score_candidates(rows, MODEL).columns == [*rows.columns, "score"]


@pytest.mark.parametrize("clearance", [0.0, 2.5])
def test_resolution_by_case_and_by_cells(spark, monkeypatch, clearance):
    rows = branches(spark)
    found = []
    for limit in (64, 5, 0):
        monkeypatch.setattr(spatial, "CASE_ROWS", limit)
        out = resolve.resolve_candidates(rows, ["case_id"], [F.col("radius_mm").desc()], parallel_clearance=clearance)
        found.append(sorted(tuple(r) for r in out.select("case_id", "instance_id", "rank", F.coalesce("reason", F.lit(""))).collect()))
    assert found[0] == found[1] == found[2]
    assert len({r[3] for r in found[0]}) > 1


def test_edges_of_small_cases_copy_no_rows(spark):
    ranked = resolve.rank_candidates(branches(spark), ["case_id"], ["radius_mm"]).drop("reason")
    assert "sequence(" not in plan(resolve.conflict_edges(ranked, ["case_id"]))


def test_tied_candidates_rank_alike_in_any_order(spark):
    rows = branches(spark, (40,)).withColumn("radius_mm", F.lit(1.0))
    ranks = []
    for order in ("instance_id", F.desc("instance_id")):
        out = resolve.resolve_candidates(rows.orderBy(order).coalesce(1), ["case_id"], ["radius_mm"])
        ranks.append(sorted((r["instance_id"], r["rank"]) for r in out.collect()))
    assert ranks[0] == ranks[1]


def test_pairs_of_small_cases_copy_no_rows(spark, monkeypatch):
    rows = branches(spark)
    left = rows.select("case_id", F.col("instance_id").alias("l"), F.col("ostium").alias("p"))
    right = rows.select("case_id", F.col("instance_id").alias("r"), F.col("ostium").alias("q"))
    near = spatial.pairs_within(left, right, ["case_id"], "p", "q", 2.0)
    assert "sequence(" not in plan(near)
    expected = sorted(map(tuple, near.collect()))
    for limit in (5, 0):
        monkeypatch.setattr(spatial, "CASE_ROWS", limit)
        assert sorted(map(tuple, spatial.pairs_within(left, right, ["case_id"], "p", "q", 2.0).collect())) == expected


def test_junctions_of_small_cases_copy_no_rows(spark, monkeypatch):
    rows = branches(spark).select("case_id", "instance_id", "path", "seed")
    junctions = rows.select("case_id", F.col("seed").alias("junction"))
    stopped = polyline.stop_at_junction(rows, junctions, ["case_id"], ["instance_id"], 1.0)
    assert "sequence(" not in plan(stopped)
    length = lambda df: {(r[0], r[1]): [round(c, 9) for p in r[2] for c in p] for r in df.select("case_id", "instance_id", "path").collect()}
    expected = length(stopped)
    for limit in (5, 0):
        monkeypatch.setattr(polyline, "CASE_ROWS", limit)
        assert length(polyline.stop_at_junction(rows, junctions, ["case_id"], ["instance_id"], 1.0)) == expected
