"""Documents of cases: all at once or none, refused where something is, and read back."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_semantics import POINT

from ostiary.functions.features import FEATURE_NAMES, LogisticModel
from ostiary.plans import batch
from ostiary.sources import documents, files

BRANCH = f"case_id string, instance_id string, ostium {POINT}, seed {POINT}, direction {POINT}, radius_mm double"


def _branches(spark):
    rows = [("case_1", f"branch_{i:03d}", (1.0 * i, 2.0, 3.0), (1.0, 2.0, 8.0), (0.0, 0.0, 1.0), 2.5) for i in (2, 1)]
    rows.append(("case_3", "branch_001", (0.0, 0.0, 0.5), (1.0, 2.0, 8.0), (0.0, 0.0, 1.0), 1.0))
    return spark.createDataFrame(rows, BRANCH)


def test_a_document_for_each_case(spark, tmp_path):
    cases = spark.createDataFrame([("case_1",), ("case_2",), ("case_3",)], "case_id string")
    target = str(tmp_path / "predictions")
    documents.write_case_predictions(cases, _branches(spark), target)
    assert sorted(os.listdir(target)) == ["case_1.json", "case_2.json", "case_3.json"] and os.listdir(tmp_path) == ["predictions"]
    with open(f"{target}/case_1.json") as file:
        first = json.load(file)
    assert set(first) == {"case_id", "parent", "daughters"} and [d["instance_id"] for d in first["daughters"]] == ["branch_001", "branch_002"]
    rows, found = files.read_predictions(spark, target)
    assert sorted(r["case_id"] for r in found.collect()) == ["case_1", "case_2", "case_3"]
    names = ["case_id", "instance_id", "ostium", "seed", "direction", "radius_mm"]
    assert sorted(map(str, rows.select(names).collect())) == sorted(map(str, _branches(spark).select(names).collect()))


def test_an_existing_target_is_left_alone(spark, tmp_path):
    target = tmp_path / "out"
    target.mkdir()
    (target / "old.json").write_text("{}")
    with pytest.raises(Exception, match="exists already"):
        documents.write_case_predictions(spark.createDataFrame([("a",)], "case_id string"), _branches(spark), str(target))
    assert os.listdir(target) == ["old.json"] and os.listdir(tmp_path) == ["out"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    names = spark.range(40).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"), F.when(
        F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.lit("{}")).alias("body"))
    with pytest.raises(Exception, match="killed"):
        spark.dataSource.register(documents.CaseDocuments)
        names.repartition(4).write.format(documents.FORMAT).mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_names_and_numbers_are_checked(spark, tmp_path):
    for rows, match in (([("a.json", "{}"), ("a.json", "{}")], "two documents"), ([("../a.json", "{}")], "file name"), ([(None, "{}")], "file name")):
        with pytest.raises(ValueError, match=match):
            documents.write_documents(spark.createDataFrame(rows, "name string, body string"), str(tmp_path / "out"))
    bad = _branches(spark).withColumn("radius_mm", F.lit(float("nan")))
    with pytest.raises(ValueError, match="JSON"):
        documents.write_case_predictions(spark.createDataFrame([("case_1",)], "case_id string"), bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def _model():
    n = len(FEATURE_NAMES)
    return LogisticModel(mean=[0.0] * n, scale=[1.0] * n, weights=[0.0] * n, bias=1.0, threshold=0.5)


def test_broken_cases_never_stop_the_others(spark):
    """Every kind of fault once; whole cases come out as they do alone."""
    ids = ["files", "scan", "mask", "grid", "features", "good", "empty"]
    scanned = spark.createDataFrame([(c, "failed" if c == "files" else "ok", "two scans" if c == "files" else None) for c in ids], "case_id string, status string, error string")
    header = "case_id string, size array<int>, components int, spacing array<double>, origin array<double>, direction array<double>"
    row = lambda c, s=1.0: (c, [4, 4, 4], 1, [1.0, 1.0, s], [0.0] * 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    images = spark.createDataFrame([row(c) for c in ids if c != "scan"], header)
    masks = spark.createDataFrame([row(c, 2.0 if c == "grid" else 1.0) for c in ids if c != "mask"], header)
    feature = "path array<struct<x:double,y:double,z:double>>, mean_vesselness double, evidence_score double, features map<string,double>"
    path = [(0.0, 0.0, 0.0), (0.0, 0.0, 5.0)]
    values = {n: 1.0 for n in FEATURE_NAMES}
    rows = [(c, "x1", 1, (9.0 * i, 0.0, 0.0), (9.0 * i, 0.0, 5.0), (0.0, 0.0, 1.0), 1.0, path, None if c == "features" else 0.5, 0.5, values)
            for i, c in enumerate(ids) if c != "empty"]
    frame = spark.createDataFrame(rows, f"case_id string, instance_id string, ord long, ostium {POINT}, seed {POINT}, direction {POINT}, radius_mm double, {feature}")
    runs = spark.createDataFrame([(c, 1.5, 2.5) for c in ids], "case_id string, detection_s double, end_to_end_s double")
    out = batch.run_batch(scanned, images, masks, frame, frame.limit(0), _model(), runs)
    got = {r["case_id"]: (r["status"], r["error"], r["branches"], r["detection_s"]) for r in out["cases"].collect()}
    assert got == {"files": ("failed", "files: two scans", None, None), "scan": ("failed", "scan: no readable header", None, None),
                   "mask": ("failed", "mask: no readable header", None, None), "grid": ("failed", "header: geometry", None, None),
                   "features": ("failed", "features: 1 without a score, first x1", None, None), "good": ("ok", None, 1, 1.5), "empty": ("ok", None, 0, 1.5)}
    assert out["totals"].first().asDict() == {"cases": 7, "failures": 5, "ok": 2}
    assert [r["case_id"] for r in out["branches"].collect()] == ["good"]
