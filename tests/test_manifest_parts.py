"""The manifest query and its SQL name the same parts when a case has more files than one record holds."""

import duckdb
from pyspark.sql import functions as F

from ostiary.plans.catalog import ORACLES, QUERIES
from ostiary.plans import all_queries  # noqa: F401
from ostiary.sources import files as fl


def test_manifest_of_more_files_than_a_record_holds(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.range(fl.RECORD_ROWS + 40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "de").otherwise("en").alias("lang"), F.col("id").cast("string").alias("text")).write.parquet(path)
    got = [tuple(r) for r in QUERIES["build_manifest"](spark, str(tmp_path)).select("case_id", "n_docs", "part", "parts", "files").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT case_id, n_docs, part, parts, files FROM ({ORACLES['build_manifest']})").fetchall()
    assert sorted(got) == sorted(want)
    assert sorted(r[:4] for r in got) == [("de", 30, 0, 1), ("en", fl.RECORD_ROWS + 10, 0, 2), ("en", fl.RECORD_ROWS + 10, 1, 2)]
