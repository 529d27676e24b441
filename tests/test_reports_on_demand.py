"""Small cases are matched inside one row, and a report makes the tables that are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary.operators import matching, spatial
from ostiary.plans import evaluation

POINT = "struct<x:double,y:double,z:double>"


def side(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(case, i, f"{seed}_{i}", tuple(map(float, p)), tuple(map(float, p + 1)), (0.6, 0.0, 0.8), float(p[0]))
            for case, n in (("a", 1), ("b", 7), ("c", 12), ("d", 20)) for i, p in enumerate(rng.random((n, 3)) * 8)]
    return spark.createDataFrame(rows, f"case_id string, ord long, instance_id string, ostium {POINT}, seed {POINT}, direction {POINT}, radius_mm double")


def test_inside_a_row_and_by_pairs(spark, monkeypatch):
    found = []
    for limit in (64, 10, 0):
        monkeypatch.setattr(spatial, "CASE_ROWS", limit)
        out = matching.match_one_to_one(side(spark, 1), side(spark, 2), [5.0, 1.0, 2.5, 5.0])
        found.append((out.columns, sorted(tuple(r) for r in out.collect())))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 40


def test_small_cases_write_and_copy_nothing(spark, monkeypatch):
    monkeypatch.setattr(matching.scale, "checkpoint", lambda df: pytest.fail("checkpoint"))
    assert matching.match_one_to_one(side(spark, 1), side(spark, 2), [2.0]).count() > 0


def test_tables_are_made_on_demand(spark, monkeypatch):
    made, match = [], evaluation.match_one_to_one
    monkeypatch.setattr(evaluation, "match_one_to_one", lambda p, r, t, **more: made.append(t) or match(p, r, t, **more))
    cases = spark.createDataFrame([(c, "f") for c in "abcde"], "case_id string, family string")
    pred, ref = side(spark, 1), side(spark, 2)
    files = spark.createDataFrame([("x", "1")], "path string, sha256 string")
    runs = cases.select("case_id", F.lit(2.0).alias("total_s"), F.lit(None).cast("double").alias("filter_s"))
    split = spark.createDataFrame([("a", "test")], "case_id string, partition string")
    report = evaluation.benchmark_report(files, cases, files, pred, ref, runs, None, split, 3.0)
    assert report["runtime"].first()["mean_runtime_s"] == 2.0 and report["overlap"].collect() == [("test", "a")]
    assert made == [] and sorted(report) == ["cases", "overlap", "runtime", "sensitivity", "summary"]
    with pytest.raises(Exception, match="integrity"):
        evaluation.benchmark_report(files.limit(0), cases, files, pred, ref, runs, None, split, 3.0)
    report = evaluation.scoring_report(cases, pred.select("case_id"), pred, ref, [2.0, 3.0])
    assert made == [] and [r[0] for r in report["missing"].collect()] == ["e"]
    assert report["matches"].count() > 0 and report["summary"].count() == 2 and made == [[2.0, 3.0]]
    assert report["mirror"].count() == 1 and report["cases"].count() == 8
