"""Reviews of small cases meet their branches by the case alone; the rows are those of a join on all keys."""

from ostiary.operators import reviews, spatial

ROWS = [("a", "x", "f1", 1), ("a", "x", "f2", 2), ("a", None, "f1", 3), ("b", "x", None, 4), ("b", "y", "f1", 5), (None, "x", "f1", 6), ("c", "x", "f1", 7)]
MARKS = [("a", "x", "f1", "confirmed"), ("a", "x", "f1", "rejected"), ("a", None, "f1", "confirmed"), ("b", "x", None, "confirmed"), ("b", "y", "f1", None),
         (None, "x", "f1", "confirmed"), ("c", "x", "old", "confirmed"), ("d", "x", "f1", "confirmed")]


def frames(spark):
    return (spark.createDataFrame(ROWS, "case_id string, instance_id string, fingerprint string, n int"),
            spark.createDataFrame(MARKS, "case_id string, instance_id string, fingerprint string, label string"))


def test_same_rows_by_both_routes(spark, monkeypatch):
    want = sorted([(1, "confirmed"), (1, "rejected"), *[(n, "unreviewed") for n in range(2, 8)]])
    for limit in (64, 3, 0):  # all cases small, mixed, all large
        monkeypatch.setattr(spatial, "CASE_ROWS", limit)
        found = reviews.review_status(*frames(spark))
        assert sorted((r["n"], r["status"]) for r in found.collect()) == want
        assert found.columns == ["case_id", "instance_id", "fingerprint", "n", "status"]


def test_rows_that_lie_by_case_are_not_shuffled(spark):
    """The join shuffled every column of the branches, paths included."""
    branches, marks = (frame.repartition(4, "case_id") for frame in frames(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reviews.review_status(branches, marks)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(case_id" in plan and not any("Exchange hashpartitioning" in line and "instance_id" in line.split("ENSURE")[0] for line in plan.splitlines())
