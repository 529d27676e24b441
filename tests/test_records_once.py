"""Records of cases that fit one part are made from one look at their rows."""

from pyspark.sql import functions as F

from ostiary.sources import files

POINT = "struct<x:double,y:double,z:double>"


def log(spark, seen=None):
    rows = [(case, f"i{n}", "strict", n, (float(n), 0.0, 0.0), 0.5) for case, size in (("a", 5), ("b", 1)) for n in range(size)]
    frame = spark.createDataFrame(rows, f"case_id string, instance_id string, profile string, merge_rank long, ostium {POINT}, score double")
    frame = frame.withColumns({"seed": F.col("ostium"), "direction": F.col("ostium"), "radius_mm": F.col("score"), "decision": F.lit("retained"),
                               "output_instance_id": F.lit("x"), "suppressor_instance_id": F.lit(None).cast("string")})
    if seen is None:
        return frame

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)  # an accumulator
            yield batch
    return frame.mapInArrow(count, frame.schema)


def records(spark, size, **options):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    found = files.diagnostic_records(cases, log(spark), size, **options).select(
        "case_id", "part", "parts", F.transform("workflow.decisions", lambda d: d["merge_rank"]).alias("ranks"))
    return sorted(((r["case_id"], r["part"], r["parts"], r["ranks"]) for r in found.collect()), key=str)


def test_parts_follow_the_sizes_of_cases(spark):
    whole = [("a", 0, 1, [0, 1, 2, 3, 4]), ("b", 0, 1, [0]), ("c", 0, 1, None)]
    assert records(spark, 5) == records(spark, 5, proposals=log(spark)) == whole
    assert records(spark, 4) == records(spark, 4, proposals=log(spark)) == [
        ("a", 0, 2, [0, 1, 2, 3]), ("a", 1, 2, [4]), ("b", 0, 1, [0]), ("c", 0, 1, None)]


def test_decisions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    made_rows = log(spark, made)
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert files.diagnostic_records(cases, made_rows, proposals=log(spark)).count() == 3
    files.diagnostic_records(cases, made_rows, proposals=log(spark)).collect()
    assert made.value <= 2 * 6
