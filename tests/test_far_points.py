"""Points far from a long line look at few of its pieces and find the same place as brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary.operators import polyline


def test_far_points_meet_few_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    line = np.column_stack([np.arange(600) * 0.5, rng.random(600) * 5, np.zeros(600)])
    spots = np.column_stack([rng.random(12) * 300, rng.random(12) * 5, np.full(12, 400.0)])
    looked = []
    inner = polyline._pieces_of_near_bins
    monkeypatch.setattr(polyline, "_pieces_of_near_bins", lambda *a: (looked.append(inner(*a).count()), inner(*a))[1])
    lines = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(line)], "case_id int, seq bigint, x double, y double, z double")
    points = spark.createDataFrame([(1, i, tuple(map(float, p))) for i, p in enumerate(spots)], "case_id int, id int, point struct<x:double,y:double,z:double>")
    found = polyline.nearest_on_polyline(points, lines, ["case_id"], ["id"], packed=8)
    got = {r["id"]: r["nearest_mm"] for r in found.select("id", "nearest_mm").collect()}
    a, b = line[:-1], line[1:]
    for i, p in enumerate(spots):
        t = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)[:, None]
        assert got[i] == pytest.approx(np.sqrt(((p - a - t * (b - a)) ** 2).sum(1)).min(), abs=1e-9)
    assert 0 < sum(looked) < 12 * 599 / 2
