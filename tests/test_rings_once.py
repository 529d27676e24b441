"""Rings of ordinary cases are read once to fill gaps, with the results of the route for large cases."""

import numpy as np
from pyspark.sql import functions as F

from ostiary.operators import rings


def test_one_window_fills_as_chunks_do(spark):
    rng = np.random.default_rng(4)
    rows = [(case, i, float(v) if v > 0.5 else None) for case in "abc" for i, v in enumerate(rng.random(40))] + [("d", 0, None), ("d", 1, None)]
    series = spark.createDataFrame(rows, "case_id string, seq long, value double")
    whole, chunks = (rings.fill_gaps(series, ["case_id"], "value", large) for large in (False, True))
    assert whole.columns == chunks.columns
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, chunks.collect()))
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_range_in_one_pass(spark):
    rng = np.random.default_rng(6)
    radii = spark.createDataFrame([(case, i, float(v)) for case in "ab" for i, v in enumerate(rng.random(30))] + [("c", 0, 1.0)],
                                  "case_id string, seq long, radius double")
    centres = spark.createDataFrame([("a", 4.2), ("a", 5.0), ("c", 0.0)], "case_id string, seq double")
    found = [sorted(tuple(r) for r in rings.trimmed_range(radii, centres, ["case_id"], limit=limit).select(
        "case_id", "seq", *[F.round(c, 9) for c in ("low", "high", "scaled")]).collect()) for limit in (None, 5)]
    assert found[0] == found[1] and len(found[0]) == 61


def test_nearest_places_are_worked_out_once(spark):
    points = spark.createDataFrame([("a", i, (float(i), 1.0, 0.0)) for i in range(6)], "case_id string, ord long, point struct<x:double,y:double,z:double>")
    line = spark.createDataFrame([("a", i, 2.0 * i, 0.0, 0.0) for i in range(4)], "case_id string, seq long, x double, y double, z double")
    plan = rings.ring_radii(points, line, ["case_id"], ["ord"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 1 and plan.count("array_min(") == 1
