"""Probes whose boxes hold the same grid places share one look at the members."""

import numpy as np
from pyspark.sql import functions as F

from ostiary.operators import cells

POINT = "struct<x:double,y:double,z:double>"


def probes_and_members(spark):
    rng = np.random.default_rng(2)
    spots = {(case, *map(int, p)) for case in "ab" for p in rng.integers(-5, 9, (80, 3))}
    near = [(case, i, tuple(map(float, p))) for case in "abz" for i, p in enumerate(rng.random((40, 3)) * 4)]
    near += [("a", 100 + i, p) for i, p in enumerate([
        (2.0, 2.0, 2.0), (2.0 + 4e-16, 1.0, 1.0), (1.0 - 1e-16, 3.0, 3.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0), (1e300, 0.0, 0.0)])]
    near += [("a", 200, None), (None, 201, (1.0, 1.0, 1.0))]
    probes = spark.createDataFrame([(c, i, p, (0.6, 0.0, 0.8)) for c, i, p in near], f"case_id string, i int, point {POINT}, direction {POINT}")
    return probes, spark.createDataFrame(sorted(spots), "case_id string, x int, y int, z int")


def test_shared_boxes_give_each_probes_own_angle(spark):
    probes, members = probes_and_members(spark)
    results = []
    for kind in ("int", "double"):
        rows = members.select("case_id", *[F.col(a).cast(kind) for a in "xyz"])
        found = cells.parent_angle(probes, rows, ["case_id"], ["i"], 3.0)
        assert sorted(found.columns) == sorted([*probes.columns, "parent_angle"])
        results.append({(r["case_id"], r["i"]): r["parent_angle"] for r in found.collect()})
    assert results[0].keys() == results[1].keys() and len(results[0]) == probes.count()
    assert all(abs(v - results[1][k]) < 1e-6 for k, v in results[0].items())
    assert len({round(v, 6) for v in results[0].values()}) > 20


def test_members_are_met_once_a_box(spark, monkeypatch):
    probes, members = probes_and_members(spark)
    rows = spark.range(500).select(F.lit("a").alias("case_id"), F.col("id").cast("int").alias("i"), F.struct(
        *[(F.rand(n) * 0.9 + 1.05).alias(a) for n, a in enumerate("xyz")]).alias("point"), F.struct(*[F.lit(0.5).alias(a) for a in "xyz"]).alias("direction"))
    met, axes = [], cells._axes
    monkeypatch.setattr(cells, "_axes", lambda near, by: met.append(near.count()) or axes(near, by))
    assert cells.parent_angle(rows, members, ["case_id"], ["i"], 12.0).count() == 500
    assert met == [members.filter("case_id = 'a'").count()]
