"""The pool of small cases is made by the case alone, and its size checks do not work it out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostiary import scale
from ostiary.operators import spatial
from ostiary.plans import batch

POINT = "struct<x:double,y:double,z:double>"


def rows(spark, profile, seed):
    rng = np.random.default_rng(seed)
    made = [(case, f"{profile}{i}", i, tuple(map(float, rng.random(3) * 9)), []) for case, n in enumerate((1, 4, 9, 40)) for i in range(n)]
    return spark.createDataFrame(made, f"case_id int, instance_id string, ord long, ostium {POINT}, warnings array<string>")


@pytest.mark.parametrize("found", [True, False])
def test_keep_within_by_case_and_by_cells(spark, monkeypatch, found):
    left, right = rows(spark, "s", 1), rows(spark, "r", 2)
    kept = []
    for limit in (64, 5, 0):
        monkeypatch.setattr(spatial, "CASE_ROWS", limit)
        near = spatial.keep_within(left, right, ["case_id"], "ostium", "ostium", 2.0, found=found)
        assert near.columns == left.columns
        assert ("sequence(" in near._jdf.queryExecution().optimizedPlan().toString()) == (limit < 40)
        kept.append(sorted((r["case_id"], r["ord"]) for r in near.collect()))
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < left.count()


def test_size_checks_look_at_the_proposals(spark, monkeypatch):
    review, strict = rows(spark, "r", 2), rows(spark, "s", 1)
    looked = []

    def checked(check):
        return lambda df, *args, **options: looked.append((df if options.get("sized") is None and len(args) < 3 else (options.get("sized") or args[2]))
                                                          ._jdf.queryExecution().optimizedPlan().toString()) or check(df, *args, **options)

    monkeypatch.setattr(scale, "has_large_group", checked(scale.has_large_group))
    monkeypatch.setattr(scale, "split_by_size", checked(scale.split_by_size))
    branches, counts = batch.candidate_pool(review, strict, ["case_id"], "ord")
    assert looked and not any("Join" in plan for plan in looked)
    got = {r["case_id"]: (r["branches"], r["strict_only_added"]) for r in counts.collect()}
    told = {r["case_id"]: (r["n"], r["a"]) for r in branches.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("added").alias("a")).collect()}
    assert got == told and sum(a for _, a in got.values()) > 0
